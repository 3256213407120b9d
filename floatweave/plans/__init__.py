"""Analysis plans over chunked series."""
