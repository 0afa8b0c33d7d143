"""Named end-to-end plans and the queries registered for verification."""
