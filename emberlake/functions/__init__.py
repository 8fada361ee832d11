"""Part of the event-risk library."""
