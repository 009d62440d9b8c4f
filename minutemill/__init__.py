"""Event counting and unique-user analytics as DataFrame-to-DataFrame functions."""
