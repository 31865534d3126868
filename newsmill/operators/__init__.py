"""DataFrame operators: joins, deduplication, ordered logic, rules, metering, digests."""
