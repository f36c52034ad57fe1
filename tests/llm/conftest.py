from ..conftest import spark  # noqa: F401
