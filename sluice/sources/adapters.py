"""Board payloads to raw posting records. JSON stays in the JVM (VARIANT); XML and HTML go through one Arrow pass, and a UDTF for SQL.

Every parser gives the columns of RECORD and keeps the payload's other columns but its body. A null or malformed
body, or one of another shape, gives no rows; an entry that isn't an object is left out.
"""

from __future__ import annotations

import html.parser
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

_TEXTS = ("source_job_id", "title", "company", "location", "remote", "url", "description", "salary", "posted_at")
RECORD = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())])

# ---- JSON


def _items(raw: DataFrame, field: str, body: str) -> DataFrame:
    """Objects of an array field of a JSON body, each as the variant ``_j``."""
    v = F.try_parse_json(F.col(body))
    list_ = F.try_variant_get(v, f"$.{field}", "array<variant>")
    rows = raw.withColumn("_j", F.explode(list_)).drop(body)
    return rows.where(F.schema_of_variant("_j").startswith("OBJECT"))


def _get(field: str, kind: str = "string") -> Column:
    return F.try_variant_get("_j", f"$.{field}", kind)


def as_list(field: str) -> Column:
    """A field that is usually a list: an object's values, a scalar alone, nothing for null and empty."""
    v = F.try_variant_get("_j", f"$.{field}", "variant")
    kind = F.schema_of_variant(v)
    none = F.array().cast("array<string>")
    return (
        F.when(v.isNull() | (kind == "VOID"), none)
        .when(kind.startswith("ARRAY"), F.coalesce(_get(field, "array<string>"), none))
        .when(kind.startswith("OBJECT"), F.coalesce(F.map_values(_get(field, "map<string,string>")), none))
        .when(_get(field) == "", none)
        .otherwise(F.array(_get(field)))
    )


def _record(rows: DataFrame, **fields: Column) -> DataFrame:
    out = []
    for f in RECORD:
        c = fields.get(f.name, F.lit(1.0) if f.name == "confidence" else F.lit(None))
        out.append(F.coalesce(c, F.array().cast("array<string>")).alias(f.name) if f.name == "tags" else c.cast(f.dataType).alias(f.name))
    own = {f.name for f in RECORD}
    return rows.select(*[c for c in rows.columns if c not in own and not c.startswith("_")], *out)


def remotive(raw: DataFrame, body: str = "body") -> DataFrame:
    """``jobs``: the region is a constraint on a remote job, the category one more tag."""
    region = F.nullif(_get("candidate_required_location"), F.lit(""))
    extra = F.when(F.coalesce(_get("category"), F.lit("")) != "", F.array(_get("category"))).otherwise(F.array().cast("array<string>"))
    tags = F.when(F.schema_of_variant(F.try_variant_get("_j", "$.tags", "variant")).startswith("ARRAY"), _get("tags", "array<string>"))
    return _record(
        _items(raw, "jobs", body), source_job_id=F.coalesce(_get("id"), F.lit("")), title=_get("title"), company=_get("company_name"),
        location=F.coalesce(F.concat(F.lit("Remote ("), region, F.lit(")")), F.lit("Remote")), remote=F.lit("true"), url=_get("url"), description=_get("description"),
        salary=_get("salary"), posted_at=_get("publication_date"), tags=F.concat(F.coalesce(tags, F.array().cast("array<string>")), extra),
    )


def arbeitnow(raw: DataFrame, body: str = "body") -> DataFrame:
    """``data``: the date is seconds since 1970, tags and job types are lists, objects or scalars."""
    return _record(
        _items(raw, "data", body), source_job_id=_get("slug"), title=_get("title"), company=_get("company_name"), location=_get("location"),
        remote=F.coalesce(_get("remote", "boolean"), F.lit(False)).cast("string"), url=_get("url"), description=_get("description"), posted_at=_get("created_at"), tags=F.concat(as_list("tags"), as_list("job_types")),
    )


def hackernews(raw: DataFrame, body: str = "body") -> DataFrame:
    """``hits``: company and role come from the title's grammar; a hit without a link gets its discussion's."""
    own = X.hiring_split(_get("title"))
    link = F.coalesce(F.nullif(_get("url"), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), _get("objectID")))
    remote = F.when(X.is_remote(_get("title")), "true").otherwise("false")
    return _record(
        _items(raw, "hits", body), source_job_id=_get("objectID"), title=own["role"], company=own["company"], remote=remote, url=link, description=_get("story_text"),
        posted_at=F.coalesce(_get("created_at_i"), _get("created_at")), tags=F.array(F.lit("yc")), confidence=own["confidence"],
    )


def board_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """``jobs`` of the synthetic board, field by field."""
    names = [f.name for f in RECORD if f.name not in ("source_job_id", "tags", "confidence")]
    return _record(_items(raw, "jobs", body), source_job_id=_get("id"), tags=as_list("tags"), **{n: _get(n) for n in names})


# ---- XML

_BARE = re.compile(r"&(?!#?[A-Za-z0-9]{1,8};)")
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_DECLARED = frozenset(("amp", "lt", "gt", "quot", "apos"))


def xml_items(text: str | None) -> list[ET.Element]:
    """``item`` and ``entry`` elements at any depth and of any namespace. Bare ampersands are repaired; a body cut short gives what it has."""
    if not text:
        return []
    text = _ENTITY.sub(lambda m: m[0] if m[1] in _DECLARED else f"&amp;{m[1]};", _BARE.sub("&amp;", text))
    parser, found = ET.XMLPullParser(("end",)), []
    try:
        parser.feed(text)
        parser.close()
    except ET.ParseError:
        pass
    try:
        for _, node in parser.read_events():
            if isinstance(node.tag, str) and node.tag.rpartition("}")[2] in ("item", "entry"):
                found.append(node)
    except ET.ParseError:
        pass
    return found


def xml_field(node: ET.Element, *names: str) -> str:
    """Of the first name whose first element has text, that text; where it has none, its ``href``."""
    for name in names:
        for child in node:
            if isinstance(child.tag, str) and child.tag.rpartition("}")[2] == name:
                if value := "".join(child.itertext()).strip() or (child.get("href") or "").strip():
                    return value
                break
    return ""


def _rss(text: str | None) -> Iterator[dict]:
    for item in xml_items(text):
        raw = xml_field(item, "title")
        if not raw:
            continue
        left, colon, right = (x.strip() for x in raw.partition(":"))
        split = colon and 0 < len(left) <= 45 and len(right) >= 3
        yield {
            "source_job_id": xml_field(item, "guid", "link"), "title": right if split else raw.strip(), "company": left if split else None, "location": xml_field(item, "region", "country") or "Anywhere", "remote": "true",
            "url": xml_field(item, "link", "id"), "description": xml_field(item, "description", "summary", "content"), "posted_at": xml_field(item, "pubDate", "published", "updated"),
            "tags": [t for t in (xml_field(item, "category"), xml_field(item, "type")) if t], "confidence": 1.0,
        }


def _board_rss(text: str | None) -> Iterator[dict]:
    for item in xml_items(text):
        raw = xml_field(item, "title")
        company, _, title = raw.partition(":")
        yield {
            "source_job_id": xml_field(item, "guid"), "title": (title or raw).strip(), "company": company.strip() if title else None, "location": xml_field(item, "region"),
            "url": xml_field(item, "link"), "description": xml_field(item, "description"), "posted_at": xml_field(item, "pubDate"), "tags": [], "confidence": 1.0,
        }


# ---- HTML

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, attributes, children in order (elements and strings)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in order of the document."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            else:
                stack.extend(reversed(n.children))
        return " ".join("".join(parts).split())

    def has(self, attr: str, part: str) -> bool:
        return part in self.attrs.get(attr, "")


class _Tree(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_html(text: str | None) -> Node:
    tree = _Tree()
    tree.feed(text or "")
    tree.close()
    return tree.root


Pick = Callable[[Node], Iterator[str]]
_elements = lambda test: lambda node: (n.text() for n in node.walk() if test(n))
_attribute = lambda name: lambda node: iter([node.attrs[name]] if name in node.attrs else [])
_link = lambda test: lambda node: (n.attrs["href"] for n in node.walk() if n.tag == "a" and "href" in n.attrs and test(n))


def _nth(tag: str, n: int) -> Pick:
    """The n-th child with a tag of any element below (or of the node itself)."""

    def pick(node: Node) -> Iterator[str]:
        for parent in (node, *node.walk()):
            own = [c for c in parent.children if isinstance(c, Node) and c.tag == tag]
            if len(own) >= n:
                yield own[n - 1].text()

    return pick


# How the three layouts of a board mark its items and fields, the expected mark first.
ITEMS = (
    lambda n: n.tag == "li" and n.has("class", "job"),
    lambda n: n.tag == "article" and n.attrs.get("data-testid") == "posting",
    lambda n: n.tag == "div" and "data-title" in n.attrs,
    lambda n: n.tag in ("li", "article", "div") and any(x.tag == "a" and x.has("href", "/jobs/") for x in n.walk()),
)
FIELDS: dict[str, tuple[Pick, ...]] = {
    "title": (_elements(lambda n: n.has("class", "job-title") or n.has("class", "posting__title")), _attribute("data-title"), _elements(lambda n: n.tag in ("h1", "h2", "h3")), _nth("span", 1)),
    "company": (_elements(lambda n: n.has("class", "company")), _elements(lambda n: n.attrs.get("data-field") == "company"), _attribute("data-co"), _nth("span", 2)),
    "location": (_elements(lambda n: n.has("class", "location")), _elements(lambda n: n.attrs.get("data-field") == "location"), _nth("span", 3)),
    "description": (_elements(lambda n: n.tag == "p"), _elements(lambda n: n.has("class", "posting__body")), _elements(lambda n: n.tag == "div" and n.has("class", "desc"))),
    "url": (_link(lambda n: n.has("class", "apply")), _link(lambda n: n.attrs.get("data-testid") == "apply-link"), _link(lambda n: True)),
}


def first_text(node: Node, ladder: tuple[Pick, ...]) -> tuple[str, int]:
    """The first non-empty text of a ladder of candidates, and which candidate gave it; -1 for none."""
    for i, pick in enumerate(ladder):
        for found in pick(node):
            if value := " ".join(found.split()):
                return value, i
    return "", -1


def confidence(won: list[int]) -> float:
    """The share of fields whose first candidate gave the value."""
    return round(sum(i == 0 for i in won) / len(won), 3) if won else 0.0


def _board_html(text: str | None) -> Iterator[dict]:
    root = parse_html(text)
    nodes = list(root.walk())
    for ladder in ITEMS:
        if items := [n for n in nodes if ladder(n)]:
            break
    for node in items:
        got = {f: first_text(node, picks) for f, picks in FIELDS.items()}
        row = {f: value for f, (value, _) in got.items()}
        if row["title"]:
            yield row | {"source_job_id": row["url"].rpartition("/")[2] or None, "tags": [], "confidence": confidence([i for _, i in got.values()])}


PARSERS: dict[str, Callable[[str | None], Iterator[dict]]] = {"rss": _rss, "board_rss": _board_rss, "board_html": _board_html}


def _python(raw: DataFrame, parser: str, body: str) -> DataFrame:
    names = [f.name for f in RECORD]
    keep = [c for c in raw.columns if c != body and c not in names]
    schema = T.StructType([*(raw.schema[c] for c in keep), *RECORD])
    parse = PARSERS[parser]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [[*own, *(r.get(n) for n in names)] for *own, text in pdf[[*keep, body]].itertuples(index=False) for r in parse(text)]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    return raw.select(*keep, body).mapInPandas(run, schema)


def weworkremotely(raw: DataFrame, body: str = "body") -> DataFrame:
    """RSS or Atom; titles split at the first colon where both sides look like a company and a role."""
    return _python(raw, "rss", body)


def board_rss(raw: DataFrame, body: str = "body") -> DataFrame:
    return _python(raw, "board_rss", body)


def board_html(raw: DataFrame, body: str = "body") -> DataFrame:
    """The first item mark that matches anything, then a ladder for each field; rows without a title are dropped."""
    return _python(raw, "board_html", body)


class ParseItems:
    """``SELECT * FROM payloads, LATERAL parse_items(parser, body)`` with the parsers of PARSERS."""

    def eval(self, parser: str, body: str):
        for r in PARSERS[parser](body):
            yield tuple(r.get(f.name) for f in RECORD)


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_items", F.udtf(ParseItems, returnType=RECORD))


#: Which parser reads a board, and its rungs by preference.
ADAPTERS: dict[str, tuple[Callable[..., DataFrame], ...]] = {
    "remotive": (remotive, remotive), "arbeitnow": (arbeitnow, arbeitnow), "weworkremotely": (weworkremotely, weworkremotely), "hackernews": (hackernews,), "board": (board_html, board_json, board_rss),
}
