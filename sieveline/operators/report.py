"""Small tables as an HTML page."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a page shows.
SHOWN = 200


def render(title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None) -> str:
    """A page with a heading, notes and a table for each section, cut at ``SHOWN`` rows as a page is read by people."""
    cell = lambda x, tag: f"<{tag}>{escape('' if x is None else f'{x:.6g}' if isinstance(x, float) else str(x))}</{tag}>"
    out = ["<!doctype html>", '<meta charset="utf-8">', f"<title>{escape(title)}</title>", f"<h1>{escape(title)}</h1>"]
    out += [f"<p><b>{escape(k)}</b>: {escape(v)}</p>" for k, v in (notes or {}).items()]
    for name, df in sections.items():
        rows = df.limit(SHOWN + 1).collect()
        out += [f"<h2>{escape(name)}</h2>", "<table>", "<tr>" + "".join(cell(c, "th") for c in df.columns) + "</tr>"]
        out += ["<tr>" + "".join(cell(x, "td") for x in row) + "</tr>" for row in rows[:SHOWN]]
        out += ["</table>"] + [f"<p>The first {SHOWN} rows.</p>"] * (len(rows) > SHOWN)
    return "\n".join(out)


def write_html(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None) -> None:
    """The page in a file of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(render(title, sections, notes).encode()))
    finally:
        stream.close()
