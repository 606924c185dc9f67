"""Command-telemetry and output-reduction analytics on Spark."""
