"""Sources: registries, rule sets, landed pages, feeds, channels, state and media."""
