"""Keelstone: a keyed-table engine expressed as DataFrame plans."""
