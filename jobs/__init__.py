"""Runnable jobs over plain paths; each is a module with a command line and a config file beside it."""
