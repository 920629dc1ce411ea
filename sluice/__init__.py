"""sluice: feed contracts compiled to Spark plans, checked, profiled and ledgered."""
