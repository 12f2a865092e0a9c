"""Errors and warnings."""


class SpineError(ValueError):
    """A wrong argument or a table that lacks what an operator needs."""


class UnsupportedScheme(SpineError):
    """A code scheme that the crosswalk doesn't hold."""


class SpineWarning(UserWarning):
    """Something was left out or filled by default."""


def need_columns(df, *names):
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise SpineError(f"column(s) not in the table: {', '.join(missing)}; it has {', '.join(df.columns)}")


def one_of(what, value, allowed):
    if value not in allowed:
        raise SpineError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value
