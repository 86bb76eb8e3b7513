"""Runnable jobs: each module has run(), a function of a session, and a command line."""
