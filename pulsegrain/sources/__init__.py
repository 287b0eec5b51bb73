"""Readers and writers: the event table, raw client events, dimension tables, driver fixtures."""
