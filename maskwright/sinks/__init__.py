"""Where findings and redacted documents go."""
