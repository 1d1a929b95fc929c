from larder.sources import envelopes, tables  # noqa: F401
