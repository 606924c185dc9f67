"""Writers of results and what reads them back."""
