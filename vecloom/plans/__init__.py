"""Session set-up and intermediate tables."""
