"""Writers: tables, text records and the network."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions import text as X
from refweave.sources.readers import file_metadata


def write_parquet(df: DataFrame, path: str, as_strings: bool = False) -> dict:
    """Overwrites ``path``; returns its metadata. A path that ``df`` reads must not be overwritten: write a new version instead."""
    out = df.select(*[F.col(c).cast("string") for c in df.columns]) if as_strings else df
    out.write.mode("overwrite").parquet(path)
    return file_metadata(df.sparkSession, path) | {"columns": df.columns}


def replace_parquet(df: DataFrame, path: str) -> dict:
    """Puts ``df`` in place of a table that it may itself read: written whole beside it first, then renamed."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark._jvm
    old, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{new}.old")
    if fs.exists(old):
        fs.rename(old, aside)
    fs.rename(fresh, old)
    if fs.exists(aside):
        fs.delete(aside, True)
    return file_metadata(spark, path) | {"columns": df.columns}


def write_csv(df: DataFrame, path: str) -> dict:
    """Comma-separated text with a header and doubled quotes, blanks around texts kept: nulls are cells without quotes, empty texts are quoted."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue='""').csv(path)
    return file_metadata(df.sparkSession, path) | {"columns": df.columns}


def write_lines(df: DataFrame, path: str, column: str = "value", order: list[str] | None = None) -> dict:
    """One line (or record of several) for each row, in the order of ``order`` over the part files."""
    out = df.orderBy(*order) if order else df
    out.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return file_metadata(df.sparkSession, path)


def _field(name: str, value: Column, spaced: bool, last: bool = False) -> Column:
    """``name = {value}``; null where the value is."""
    return F.concat(F.lit(f"  {name} = {{" if spaced else f"  {name}={{"), value, F.lit("}" if last else "},"))


def bibtex(pmid: Column, title: Column, authors: Column, journal: Column, date: Column, abstract: Column, keywords: Column, doi: Column) -> Column:
    """A record without references; lines of null values are left out. ``authors`` are (firstname, lastname) pairs, ``date`` a date."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@ARTICLE{PMID"), pmid, F.lit(",")),
        _field("title", title, True),
        _field("author", F.array_join(X.full_names(authors), " and "), True),
        _field("journal", journal, True),
        _field("date", F.date_format(date, "yyyy-MM-dd"), True),
        _field("year", F.year(date).cast("string"), True),
        _field("abstract", abstract, True),
        _field("keywords", F.array_join(keywords, "; "), True),
        _field("doi", F.lower(doi), True),
        _field("PMID", pmid, True, last=True),
        F.lit("}"),
    )


def bibtex_with_references(key: Column, title: Column, authors: Column, journal: Column, year: Column, abstract: Column, keywords: Column, doi: Column, references: Column) -> Column:
    """A record with its references, joined by "; "; optional lines of empty values are left out."""

    def some(c: Column) -> Column:
        return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, c)

    names = F.transform(authors, lambda p: X.inverted_name(p["firstname"], p["lastname"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@ARTICLE{"), key, F.lit(",")),
        _field("title", X.blank_if_null(title), False),
        _field("author", F.array_join(names, " and "), False),
        _field("journal", X.blank_if_null(journal), False),
        _field("year", some(year), False),
        _field("abstract", some(abstract), False),
        _field("keywords", some(F.array_join(keywords, "; ")), False),
        _field("references", some(F.array_join(references, "; ")), False),
        _field("doi", X.blank_if_null(doi), False, last=True),
        F.lit("}\n"),
    )


def medline(pmid: Column, date: Column, journal: Column, title: Column, authors: Column, abstract: Column, doi: Column, keywords: Column) -> Column:
    """A MEDLINE record; optional lines of null or empty values are left out."""

    def line(tag: str, c: Column) -> Column:
        return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"{tag:<4}- "), c))

    people = F.transform(authors, lambda p: F.concat_ws("\n", line("FAU", X.inverted_name(p["firstname"], p["lastname"])), line("AU", X.short_name(p["firstname"], p["lastname"]))))
    return F.concat_ws(
        "\n",
        line("PMID", pmid),
        F.lit("OWN - NLM"),
        F.lit("STAT- PubMed"),
        line("DA", F.year(date).cast("string")),
        line("TA", journal),
        line("JT", journal),
        line("DP", F.year(date).cast("string")),
        line("TI", X.wrapped(title)),
        F.nullif(F.array_join(people, "\n"), F.lit("")),
        line("AB", X.wrapped(abstract)),
        line("LID", F.concat(F.nullif(doi, F.lit("")), F.lit(" [doi]"))),
        F.nullif(F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("OT  - "), k)), "\n"), F.lit("")),
        F.lit("LA  - eng"),
        F.lit("PT  - Journal Article"),
        F.lit(""),
    )


GRAPHML_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="v_name" for="node" attr.name="name" attr.type="string"/>
  <key id="v_x" for="node" attr.name="x" attr.type="double"/>
  <key id="v_y" for="node" attr.name="y" attr.type="double"/>
  <graph id="G" edgedefault="directed">"""
GRAPHML_TAIL = "  </graph>\n</graphml>"


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, value): the lines of the document, in the order of part and key. vertices: id, name, x, y; edges: src_id, dst_id."""
    spark = vertices.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(GRAPHML_HEAD).alias("value"))
    tail = spark.range(1).select(F.lit(3), F.lit(""), F.lit(GRAPHML_TAIL))
    node = F.format_string('    <node id="n%d"><data key="v_name">%s</data><data key="v_x">%s</data><data key="v_y">%s</data></node>', "id", X.xml_escaped(F.col("name")), F.col("x").cast("string"), F.col("y").cast("string"))
    edge = F.format_string('    <edge source="n%d" target="n%d"/>', "src_id", "dst_id")
    return head.union(vertices.select(F.lit(1), F.lpad(F.col("id").cast("string"), 19, "0"), node)).union(edges.select(F.lit(2), F.concat(F.lpad(F.col("src_id").cast("string"), 19, "0"), F.lpad(F.col("dst_id").cast("string"), 19, "0")), edge)).union(tail)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> dict:
    return write_lines(graphml_lines(vertices, edges), path, order=["part", "key"])


#: A picture shows this many edges; beyond them those with the least hash, whose vertices are drawn too.
DRAWN = 20_000


def svg_lines(vertices: DataFrame, edges: DataFrame, drawn: int = DRAWN, size: int = 1000) -> list[str]:
    """A drawing of the network (vertices: name, x, y; edges: src, dst) of at most ``drawn`` edges, which is what a picture can show."""
    shown = edges.select("src", "dst").distinct().orderBy(F.xxhash64("src", "dst"), "src", "dst").limit(drawn)
    a, b = vertices.select(F.col("name").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), vertices.select(F.col("name").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = shown.join(a, "src").join(b, "dst").orderBy("src", "dst").collect()  # drawn rows
    box = vertices.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, y0 = box["x0"] or 0.0, box["y0"] or 0.0
    scale = size / max((box["x1"] or 0.0) - x0, (box["y1"] or 0.0) - y0, 1e-9)

    def at(x: float, y: float) -> tuple[float, float]:
        return round((x - x0) * scale, 1), round((y - y0) * scale, 1)

    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-10 -10 {size + 20} {size + 20}">']
    points: dict = {}
    for r in rows:
        (x1, y1), (x2, y2) = at(r["x1"], r["y1"]), at(r["x2"], r["y2"])
        points[r["src"]], points[r["dst"]] = (x1, y1), (x2, y2)
        lines.append(f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="#999" stroke-width="0.5"/>')
    lines += [f'<circle cx="{x}" cy="{y}" r="2" fill="#c33"/>' for x, y in points.values()]
    return [*lines, "</svg>"]


def write_svg(vertices: DataFrame, edges: DataFrame, path: str, drawn: int = DRAWN) -> dict:
    spark = vertices.sparkSession
    lines = spark.createDataFrame([("\n".join(svg_lines(vertices, edges, drawn)),)], "value string").coalesce(1)
    return write_lines(lines, path)


def scatter_html(points: list[tuple[float, float]], title: str, width: int = 500, height: int = 250) -> str:
    """A static page with a scatter plot of a few points."""
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]

    def at(v: float, low: float, high: float, size: int) -> float:
        return round(20 + (size - 40) * (v - low) / ((high - low) or 1), 1)

    marks = "".join(f'<circle cx="{at(x, min(xs), max(xs), width)}" cy="{round(height - at(y, min(ys), max(ys), height), 1)}" r="7" fill="red"/>' for x, y in points)
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{safe}</title></head><body><svg width="{width}" height="{height}">{marks}</svg></body></html>'


def write_html(spark: SparkSession, page: str, path: str) -> dict:
    return write_lines(spark.createDataFrame([(page,)], "value string").coalesce(1), path)
