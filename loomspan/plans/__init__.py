"""Pattern and rule languages: reading, expanding, checking, planning."""
