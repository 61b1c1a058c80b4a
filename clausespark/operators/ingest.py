"""From page elements to chapters, clauses, tables, rows, cells and images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import refs as R
from clausespark.functions import text as X
from clausespark.session import cut_lineage
from clausespark.sources import html_files

#: What a page adds to an element: its role and the page's running state up to it.
STATE = (
    "role string, chapter_order bigint, chapter_title string, banner string, appendix_title string, clause_order bigint, "
    "image_order bigint, table_order bigint, unnumbered bigint, anchor string"
)
ROWS_TOGETHER = 4096


def role_of(tag: str, classes: list[str], element_id: str | None) -> str | None:
    """What an element is, by the first rule that fits."""
    if tag == "a":
        return "anchor" if element_id else None
    if tag != "div":
        return {"img": "image", "table": "table"}.get(tag)
    upper = [c.upper() for c in classes]
    rules = (
        ("header", "TEXT_HEADER_DEFAULT" in classes), ("banner", any(c.startswith("APPL_BANNER") for c in upper)),
        ("appendix_title", "ACT_TITLE_APPL" in upper), ("clause", "ACT_TEXT" in classes),
    )
    return next((name for name, fits in rules if fits), None)


def page_rows(doc_id, html: str) -> list[tuple]:
    """Elements of one page with its state: chapters, appendix, running numbers and anchors, in one pass.

    A chapter starts at a non-empty header and resets the appendix. Clauses count from thirty characters on,
    images once per source, tables if they have cells; a table without a number of its own or of an appendix
    moves the fallback counter.
    """
    rows, events, seen = [], [], set()
    count = dict.fromkeys(("chapter", "clause", "image", "table", "unnumbered"), 0)
    chapter = banner = title = None
    for e in html_files.elements(doc_id, html):
        role, order = role_of(e.tag, e.classes, e.id), dict.fromkeys(("clause", "image", "table", "unnumbered"))

        def step(name: str) -> None:
            count[name] += 1
            order[name] = count[name]

        kind = value = None
        if role == "header" and e.text:
            count["chapter"] += 1
            chapter, banner, title = e.text, None, None
        elif role == "banner" and html_files.names_appendix(e.spaced):
            banner = e.spaced
        elif role == "appendix_title":
            title = e.spaced or None
        elif role == "anchor":
            kind, value = ("hold" if e.has_img else "anchor"), e.id
        elif role == "clause" and len(e.text) >= K.MIN_TEXT_LEN:
            kind = "clause"
            step("clause")
        elif role == "image":
            kind, value = "image", e.src
            if e.src and e.src not in seen:
                seen.add(e.src)
                step("image")
        elif role == "table":
            if banner is None and not html_files.names_table(e.label) and not html_files.names_appendix(e.label):
                count["unnumbered"] += 1
            order["unnumbered"] = count["unnumbered"]
            if e.cells:
                kind = "table"
                step("table")
        if kind:
            events.append((e.pos, kind, value, e.parent_anchor))
        rows.append((*e, role, count["chapter"], chapter, banner, title, order["clause"], order["image"], order["table"], order["unnumbered"]))
    anchors = dict(fold_anchors(events))
    return [(*r, anchors.get(r[1])) for r in rows]


def segment(pages: DataFrame, *roles: str) -> DataFrame:
    """Elements of pages (doc_id, html) with their page-local state; a page is one parsed row, so nothing is shuffled.

    The state is that of the whole page; of the elements only those of ``roles`` leave the task, all if none is named.
    """
    schema = f"{html_files.ELEMENT_SCHEMA.format(key=pages.schema['doc_id'].dataType.simpleString())}, {STATE}"
    names = [*html_files.Element._fields, *[c.split()[0] for c in STATE.split(", ")]]
    role = names.index("role")

    def parse(batches):
        rows = []
        for frame in batches:
            for doc_id, html in zip(frame["doc_id"], frame["html"]):
                rows += [r for r in page_rows(doc_id, html or "") if not roles or r[role] in roles]
                if len(rows) >= ROWS_TOGETHER:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    t = pages.select("doc_id", "html").mapInPandas(parse, schema)
    return t.withColumn("appendix_number", _either_number(F.col("banner")))


def _either_number(text: Column) -> Column:
    return R.first_appendix_number(F.lower(text))


def chapters(segmented: DataFrame) -> DataFrame:
    h = segmented.where((F.col("role") == "header") & (F.col("text") != ""))
    return h.select("doc_id", "chapter_order", F.col("text").alias("title"))


def clauses(segmented: DataFrame) -> DataFrame:
    """Clause texts of at least thirty characters in running order."""
    c = segmented.where("clause_order IS NOT NULL")
    return c.select("doc_id", "pos", "clause_order", "chapter_order", "chapter_title", X.clause_number("text").alias("clause_number"), "text")


def images(segmented: DataFrame) -> DataFrame:
    """First image per source of a page, with the chapter and appendix it stands in."""
    return segmented.where("image_order IS NOT NULL").select(
        "doc_id", "pos", "image_order", "chapter_order", F.col("chapter_title").alias("section_title"), "appendix_number",
        F.col("appendix_title").alias("title"), F.col("src").alias("image_url"), F.col("context").alias("context_text"), "parent_anchor",
    )


def tables(segmented: DataFrame) -> DataFrame:
    """Tables with a resolved number and title."""
    t = segmented.where("table_order IS NOT NULL").withColumn("label", F.coalesce("label", F.lit("")))
    named = R.label_table_number(F.lower("label"))
    appendix = F.coalesce(_either_number(F.col("label")), F.col("appendix_number"))
    number = F.coalesce(named, F.concat(F.lit("ilova-"), appendix), F.col("unnumbered").cast("string"))
    title = F.when(F.col("label") != "", R.label_title(F.col("label")))
    return t.select(
        "doc_id", "pos", "table_order", "chapter_order", F.col("chapter_title").alias("section_title"), number.alias("table_number"), title.alias("title"),
        F.col("html").alias("raw_html"), "cells",
    )


def anchors(segmented: DataFrame) -> DataFrame:
    """(doc_id, pos, role, anchor) of the clauses, tables and images that get an anchor."""
    return segmented.where("anchor IS NOT NULL").select("doc_id", "pos", "role", "anchor")


def fold_anchors(events) -> list[tuple[int, str]]:
    """Anchor of each item: waiting anchors go to the next item, others back to the latest item without one.

    Tables are asked first, then clauses, then images, whichever came last of its kind.
    """
    waiting, latest, given, seen = None, {}, {}, set()
    for pos, kind, value, parent in events:
        if kind == "hold":
            waiting = value
        elif kind == "anchor":
            open_ = next((latest[k] for k in ("table", "clause", "image") if k in latest and not given.get(latest[k])), None)
            if open_ is None:
                waiting = value
            else:
                given[open_] = value
        elif kind == "image":
            if value and value not in seen:
                seen.add(value)
                latest["image"] = pos
                given[pos] = waiting or parent
            waiting = None
        else:
            latest[kind] = pos
            given[pos] = waiting
            waiting = None
    return [(p, a) for p, a in sorted(given.items()) if a]


def cells(table_rows: DataFrame) -> DataFrame:
    """Cells with their start column after row and column spans, and whether a cell was carried.

    Placement depends on the cells before it, so each table is placed on its own, one row at a time in
    the task that holds it; no shuffle is needed.
    """
    key = table_rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, table_order bigint, row_index int, col_index int, text string, is_header boolean, row_span int, col_span int, carried boolean"

    def place(batches):
        for frame in batches:
            out = []
            for doc, order, cs in zip(frame["doc_id"], frame["table_order"], frame["cells"]):
                out += [(doc, order, *c) for c in place_cells(cs)]
            yield pd.DataFrame(out, columns=["doc_id", "table_order", "row_index", "col_index", "text", "is_header", "row_span", "col_span", "carried"])

    return table_rows.select("doc_id", F.col("table_order").cast("bigint").alias("table_order"), "cells").mapInPandas(place, schema)


def place_cells(cs) -> list[tuple]:
    """(row, column, text, header, row span, column span, carried) of every grid position that holds a value.

    A cell goes to the first free column of its row and covers a rectangle; positions of the rectangle other
    than its corner are carried copies. Rectangles end with the last row of the table; where two overlap, the
    earlier cell keeps the position.
    """
    grid: dict[tuple[int, int], tuple] = {}
    last = max((c["row"] for c in cs), default=0)
    free: dict[int, int] = {}
    for c in cs:
        r, high, wide = c["row"], int(c["row_span"]), int(c["col_span"])
        col = free.get(r, 1)
        while (r, col) in grid:
            col += 1
        grid[r, col] = (c["text"], bool(c["is_header"]), high, wide, False)
        for y in range(r, min(r + high, last + 1)):
            for x in range(col, col + wide):
                grid.setdefault((y, x), (c["text"], False, 1, 1, True))
        free[r] = col + wide
    return [(*at, *grid[at]) for at in sorted(grid)]


def markdown(grid: DataFrame) -> DataFrame:
    """Markdown of every table from its placed cells, rows padded to the widest one."""
    width = Window.partitionBy("doc_id", "table_order")
    esc = F.replace("text", F.lit("|"), F.lit("\\|"))
    g = grid.groupBy("doc_id", "table_order", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", esc.alias("t")))).alias("cs"))
    g = g.withColumn("w", F.max(F.size("cs")).over(width))
    vals = F.concat(F.transform("cs", lambda c: c["t"]), F.array_repeat(F.lit(""), (F.col("w") - F.size("cs")).cast("int")))
    line = F.concat(F.lit("| "), F.array_join(vals, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), " | "), F.lit(" |"))
    first = F.min("row_index").over(width)
    g = g.withColumn("line", F.when(F.col("row_index") == first, F.concat_ws("\n", line, rule)).otherwise(line))
    m = g.groupBy("doc_id", "table_order").agg(F.array_sort(F.collect_list(F.struct("row_index", "line"))).alias("ls"))
    return m.select("doc_id", "table_order", F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("markdown"))


def row_search_text(grid: DataFrame, table_info: DataFrame) -> DataFrame:
    """Search text per table row; column names come from the first row that has any header cell.

    table_info: doc_id, table_order, code, table_number, section_title, title.
    """
    own = cut_lineage(grid.where("NOT carried AND text <> ''"))  # read three times, and cells come from parsed pages
    key = ["doc_id", "table_order"]
    heads = own.where("is_header")
    first = heads.groupBy(*key).agg(F.min("row_index").alias("row_index"))
    names = heads.join(first, [*key, "row_index"]).groupBy(*key, "col_index").agg(F.max("text").alias("head"))
    v = own.join(names, [*key, "col_index"], "left")
    named = F.coalesce(F.lower("head") != F.lower("text"), F.lit(False))
    part = F.when(named, F.concat("head", F.lit(": "), "text")).otherwise(F.concat(F.lit("Ustun "), F.col("col_index").cast("string"), F.lit(": "), "text"))
    g = v.groupBy(*key, "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", part.alias("p")))).alias("ps"))
    j = g.join(table_info, key)
    line = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(name), F.col(c)))
    values = F.array_join(F.transform("ps", lambda s: s["p"]), " | ")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Hujjat: "), "code"), F.concat(F.lit("Jadval: "), "table_number"), F.concat(F.lit("Satr: "), F.col("row_index").cast("string")),
        line("Bo'lim: ", "section_title"), line("Sarlavha: ", "title"), F.concat(F.lit("Qiymatlar: "), values),
    )
    return j.select(*key, "row_index", text.alias("search_text"))


def image_search_text() -> Column:
    """Search text of an image row with its document code."""
    line = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(name), F.col(c)))
    return F.concat_ws(
        "\n", F.concat(F.lit("Hujjat: "), "code"), F.concat(F.lit("Rasm URL: "), "image_url"), line("Bo'lim: ", "section_title"),
        line("Ilova: ", "appendix_number"), line("Sarlavha: ", "title"), line("Kontekst: ", "context_text"),
    )


def infer_codes(documents: DataFrame, titles: DataFrame) -> DataFrame:
    """Documents renamed to the code their title states, unless the category has that code already.

    documents: document_id, category, code. titles: document_id, title.
    """
    t = titles.select("document_id", R.title_doc_code(X.squeeze("title")).alias("stated"))
    j = documents.join(t, "document_id", "left").withColumn("wants", F.col("stated").isNotNull() & (F.col("stated") != F.col("code")))
    taken = documents.select("category", F.col("code").alias("stated")).distinct().withColumn("_taken", F.lit(True))
    j = j.join(taken, ["category", "stated"], "left")
    # of several documents that would take one code, the first does
    claims = j.where("wants AND _taken IS NULL").groupBy("category", "stated").agg(F.min("document_id").alias("_winner"))
    j = j.join(claims, ["category", "stated"], "left")
    ok = F.coalesce(F.col("wants") & F.col("_taken").isNull() & (F.col("_winner") == F.col("document_id")), F.lit(False))
    return j.select("document_id", "category", F.when(ok, F.col("stated")).otherwise(F.col("code")).alias("code"), ok.alias("renamed"))


def replace_documents(snapshot: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Snapshot with all rows of the re-parsed documents replaced by the fresh ones."""
    return snapshot.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(snapshot.columns))
