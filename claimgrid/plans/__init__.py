"""Plan-level helpers: skew-safe ordered computation, greedy fits, TTL chains."""
