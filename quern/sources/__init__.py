from quern.sources.tables import read_table, with_event_time, write_table

__all__ = ["read_table", "with_event_time", "write_table"]
