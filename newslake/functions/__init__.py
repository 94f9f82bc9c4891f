"""Column functions: ids and URLs, text and HTML, dates."""

from newslake.functions import dates, text, urls  # noqa: F401
