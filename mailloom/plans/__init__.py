"""Building blocks of plans: shared storage and distributed ranks."""
