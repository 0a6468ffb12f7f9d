"""The engine has no streaming operators: all of its statistics are of finished evaluation data."""
