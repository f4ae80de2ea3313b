"""What tests share."""

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    """Rows as sorted tuples by column name, floats rounded."""
    import pandas as pd

    pdf = df if isinstance(df, pd.DataFrame) else df.toPandas()
    fix = lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NA else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    out = [tuple(fix(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)]
    return sorted(out, key=repr)
