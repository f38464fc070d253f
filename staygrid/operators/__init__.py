"""Frame operators: lazy, no action inside, no window over a whole series."""
