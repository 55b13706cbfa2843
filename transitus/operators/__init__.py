"""DataFrame → DataFrame operators; every one takes its rule tables and `as_of` as arguments."""
