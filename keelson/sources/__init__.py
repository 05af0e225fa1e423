"""Reading tables and streams, writing results."""
