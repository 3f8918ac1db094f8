"""Sources and sinks: JSON, feeds, pages, listings, snapshots, archives."""
