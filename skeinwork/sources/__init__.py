"""Tables that chains read."""
