"""Multi-step plans: index build, search, status."""
