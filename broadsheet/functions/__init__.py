"""Native column expressions; none of them runs Python per row."""
