"""Fixed values of the log."""

#: Operation types of a log record (fixed values).
PUT, DELETE = 1, 2
