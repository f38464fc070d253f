"""Training-data operators on a ``documents`` table; nothing else in the library imports them."""
