"""DataFrame-to-DataFrame operators over the ledger entities."""
