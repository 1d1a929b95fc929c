from larder.functions import scalars, text  # noqa: F401
