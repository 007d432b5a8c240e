"""Plans: what a configuration or a formula asks for, as DataFrame operations."""
