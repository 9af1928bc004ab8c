"""Reading URL data; reading and writing results."""
