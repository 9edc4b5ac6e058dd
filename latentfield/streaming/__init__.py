"""The demand field over streams of events."""
