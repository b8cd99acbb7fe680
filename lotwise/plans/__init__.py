"""Layout rules, the shard store, and the registered queries."""
