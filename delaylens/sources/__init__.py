"""Sources and sinks: raw CSV zone, fixture mapping, master table, lookups."""
