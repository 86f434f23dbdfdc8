"""The physical plan of a DataFrame as text."""

import contextlib
import io


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
