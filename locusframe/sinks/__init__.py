"""Writers of the exchange formats."""
