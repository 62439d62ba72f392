"""Graph export text: statements to node and edge tables."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from otflow.functions import columns as X


def _scan(text: str) -> Iterator[tuple[int, str, int]]:
    """(place, character, bracket depth) of the characters outside quotes; a backslash hides the next one."""
    quote, depth, skip = "", 0, False
    for k, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c in "([{") - (c in ")]}")
            yield k, c, depth


_SPECIAL = re.compile(r"""[\\'"()\[\]{};]""")
#: State of the lexer: the open quote, whether the next character is hidden, the bracket depth.
State = tuple[str, bool, int]
START: State = ("", False, 0)


def lexed(text: str, state: State = START) -> tuple[State, list[tuple[int, int]]]:
    """The state after a text, and place and depth of its semicolons outside quotes."""
    quote, skip, depth = state
    if not text:
        return state, []
    marks, free = [], int(skip)  # characters before free are hidden
    for found in _SPECIAL.finditer(text):
        k, c = found.start(), found[0]
        if k < free:
            continue
        if c == "\\":
            free = k + 2
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            marks.append((k, depth))
        else:
            depth += 1 if c in "([{" else -1
    return (quote, free > len(text), depth), marks


class Chunk:
    """What a piece of text does to the lexer, whatever its state before: states compose like functions.

    For each quote and hiding before it: the state after it, with its change of
    depth, and the last semicolon at each relative depth.
    """

    def __init__(self, text: str):
        self.n = len(text)
        self.effects = {}
        for quote in ("", "'", '"'):
            for skip in (False, True):
                if skip and text and not _SPECIAL.match(text):
                    self.effects[quote, skip] = self.effects[quote, False]
                    continue
                after, marks = lexed(text, (quote, skip, 0))
                self.effects[quote, skip] = after, {depth: k for k, depth in marks}

    def after(self, state: State) -> tuple[State, int | None]:
        """The state after the piece, and the place of the last semicolon that ends a statement in it."""
        (quote, skip, change), last = self.effects[state[:2]]
        ends = [k for depth, k in last.items() if state[2] + depth <= 0]
        return (quote, skip, state[2] + change), max(ends, default=None)


def entries(chunks: list[Chunk], base: int = 0) -> list[tuple[State, int, int]]:
    """For each piece of a text: the state before it, its place, and the place where the statement begins that is open there."""
    out, state, begin = [], START, base
    for chunk in chunks:
        out.append((state, base, begin))
        state, last = chunk.after(state)
        if last is not None:
            begin = base + last + 1
        base += chunk.n
    return out


def cut(text: str, state: State, base: int, begin: int, last: bool) -> list[tuple[int, bool, str]]:
    """The statements of a piece: place where each begins, whether the text is all of it, and the text.

    last: the piece ends its file, so what is open at its end is whole.
    """
    places = [k for k, depth in lexed(text, state)[1] if depth <= 0]
    bounds = [-1, *places, len(text)]
    out = []
    for n, (a, z) in enumerate(zip(bounds, bounds[1:])):
        start = base + a + 1 if n else begin
        whole = (n > 0 or begin == base) and (n < len(places) or last)
        out.append((start, whole, text[a + 1 : z]))
    return out


def split(text: str, mark: str) -> list[str]:
    """The parts between marks outside quotes and brackets. Comments are not known, so their quotes count."""
    cuts = [k for k, c, depth in _scan(text) if c == mark and depth <= 0]
    bounds = [-1, *cuts, len(text)]
    return [p for a, b in zip(bounds[:-1], bounds[1:]) if (p := text[a + 1 : b].strip())]


def block(text: str, at: int) -> str | None:
    """What the braces that open at or after a place enclose."""
    begin = text.find("{", at)
    if begin < 0:
        return None
    depth = 0
    for k, c, _ in _scan(text[begin:]):
        depth += (c == "{") - (c == "}")
        if not depth:
            return text[begin + 1 : begin + k]
    return None


def literal(text: str):
    """A string without its quotes (escapes stay), true, false, null, a number, a list, or the text itself."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text.lower()]
    if text.startswith("[") and text.endswith("]"):
        return [literal(p) for p in split(text[1:-1], ",")]
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def properties(body: str | None) -> dict:
    out = {}
    for part in split(body or "", ","):
        key, colon, value = part.partition(":")
        if colon:
            out[key.strip().strip("`'\"")] = literal(value)
    return out


_NODE = re.compile(r"\(\s*(\w*)\s*:\s*(\w+)\s*\{")
_EDGE = re.compile(r"\(\s*(\w+)[^()]*\)\s*-\s*\[\s*\w*\s*:\s*`?(\w+)`?")
_ARROW = re.compile(r"\]\s*->\s*\(\s*(\w+)")
_VERB = re.compile(r"\b(?:MERGE|CREATE)\b", re.I)


def parse(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a text, each with the number of its statement."""
    nodes, edges = [], []
    for seq, statement in enumerate(split(text, ";")):
        found = parse_statement(statement)
        nodes += [{"seq": seq} | n for n in found[0]]
        edges += [{"seq": seq} | e for e in found[1]]
    return nodes, edges


def parse_statement(statement: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one statement."""
    nodes, edges, aliases = [], [], {}
    for found in _NODE.finditer(statement):
        props = properties(block(statement, found.end() - 1))
        if "guid" in props:
            aliases[found[1]] = props["guid"]
            nodes.append({"guid": str(props["guid"]), "label": found[2], "props": props})
    verb = _VERB.search(statement)
    for found in _EDGE.finditer(statement, verb.start() if verb else len(statement)):
        arrow = _ARROW.search(statement, found.end())
        if not arrow or found[1] not in aliases or arrow[1] not in aliases:
            continue
        body = block(statement[: arrow.start()], found.end())
        edges.append({"src": str(aliases[found[1]]), "dst": str(aliases[arrow[1]]), "rel": found[2], "props": properties(body)})
    return nodes, edges


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ",".join(_text(v) or "null" for v in value) + "]"
    return str(value)


def _addresses(props: dict) -> list[str]:
    """ipAddresses (a list, or text of one) and ipAddress, those that are IPv4."""
    many = props.get("ipAddresses") or []
    if isinstance(many, str):
        many = re.findall(r"[\d.]+", many)
    found = [*many, *([props["ipAddress"]] if props.get("ipAddress") else [])]
    return [ip for ip in dict.fromkeys(map(str, found)) if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", ip) and all(int(p) <= 255 for p in ip.split("."))]


_TOLD = (
    "seq long, whole boolean, place long, text string, nodes array<struct<guid:string,label:string,host:string,ips:array<string>,props:map<string,string>>>, "
    "edges array<struct<src:string,dst:string,rel:string,props:map<string,string>>>"
)


def _told(seq: int, text: str) -> dict:
    nodes, edges = parse_statement(text)
    plain = lambda props: [(k, _text(v)) for k, v in props.items()]
    nodes = [n | {"host": _text(n["props"].get("hostname") or n["props"].get("host")), "ips": _addresses(n["props"]), "props": plain(n["props"])} for n in nodes]
    return {"seq": seq, "whole": True, "place": seq, "text": None, "nodes": nodes, "edges": [e | {"props": plain(e["props"])} for e in edges]}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The text between newlines: file (its path), block (where the split begins) and value, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """(file, block) and text of each split of a task; one is held at a time."""
    here, lines = None, []
    for batch in batches:
        for file, start, value in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if (file, start) != here:
                if here is not None:
                    yield here, "\n".join(lines) + "\n"
                here, lines = (file, start), []
            lines.append(value)
    if here is not None:
        yield here, "\n".join(lines) + "\n"


def statements(spark: SparkSession, path: str) -> DataFrame:
    """The parsed statements of the text at path: seq (place of the statement's begin), nodes and edges.

    A text of any size is split. Tasks first tell what their split does to the
    lexer, of which the driver holds one small row a split; composed in order
    these give each split's state, and tasks cut and parse. Only the statements
    that a split's edge cuts are gathered.
    """
    source = _lines(spark, path)

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), text in _splits(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start]), pa.array([pickle.dumps(Chunk(text))])], ["file", "block", "chunk"])

    found = {(r["file"], r["block"]): pickle.loads(r["chunk"]) for r in source.mapInArrow(lex, "file string, block long, chunk binary").collect()}
    told, base = {}, 0
    for file in sorted({f for f, _ in found}):
        keys = sorted(k for k in found if k[0] == file)
        for key, entry in zip(keys, entries([found[k] for k in keys], base)):
            told[key] = (*entry, key == keys[-1])
        base += sum(found[k].n for k in keys)
    shared, arrow = spark.sparkContext.broadcast(told), to_arrow_schema(StructType.fromDDL(_TOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in _splits(batches):
            state, base, begin, last = shared.value[key]
            rows = []
            for seq, whole, part in cut(text, state, base, begin, last):
                rows.append(_told(seq, part) if whole else {"seq": seq, "whole": False, "place": base, "text": part, "nodes": [], "edges": []})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_told(r["seq"], r["text"]) for r in batch.to_pylist()], arrow)

    # Read once for what is whole and what isn't; what is lost with an executor is read again.
    rows = source.mapInArrow(run, _TOLD).persist(StorageLevel.MEMORY_AND_DISK)
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    # A statement goes on in each split at most once, so its parts are its length.
    joined = rows.where("not whole").groupBy("seq").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).mapInArrow(join, _TOLD)
    return rows.where("whole").unionByName(joined).select("seq", "nodes", "edges").where("size(nodes) > 0 or size(edges) > 0")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (the first statement of a guid wins) and edges of the text at path; seq orders them as in the text."""
    found = statements(spark, path)
    nodes = found.select("seq", F.explode("nodes").alias("n")).select("seq", "n.*")
    edges = found.select("seq", F.explode("edges").alias("e")).select("seq", "e.*")

    from otflow.operators.graph import dedupe_nodes

    return dedupe_nodes(nodes, "seq"), edges


def telemetry(nodes: DataFrame, edges: DataFrame, rels: tuple[str, ...] = ("CONNECT_TO",)) -> DataFrame:
    """Anchors (see operators.correlate) of the edges that name both addresses and a server port.

    What an edge doesn't tell is taken from the nodes at its ends.
    """
    ends = lambda side: nodes.select(F.col("guid").alias(side), F.try_element_at("ips", F.lit(1)).alias(f"{side}_node_ip"), F.col("label").alias(f"{side}_label"), F.col("props").alias(f"{side}_props"))
    e = edges.where(F.col("rel").isin(*rels)).join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    prop = lambda *names: F.coalesce(*[F.nullif(F.col("props")[n], F.lit("")) for n in names])
    dst = lambda n: F.col("dst_props")[n]
    list_of = lambda n: F.split(F.regexp_replace(F.coalesce(F.col("props")[n], F.lit("")), r"[\[\]\s]", ""), ",")
    ports = F.transform(F.filter(list_of("sessionPorts"), lambda x: x != ""), lambda x: x.try_cast("int"))
    times = F.transform(F.filter(list_of("sessionTimestamps"), lambda x: x != ""), lambda x: F.when(x.try_cast("double") > 1e12, x.try_cast("double") * 1000).otherwise(x.try_cast("double") * 1_000_000).cast("long"))
    sessions = F.transform(F.filter(F.arrays_zip(ports.alias("port"), times.alias("ts_us")), lambda s: s["port"].isNotNull() & s["ts_us"].isNotNull()), lambda s: F.struct(s["port"].alias("port"), s["ts_us"].alias("ts_us")))
    is_process = F.lower("src_label") == "process"
    own = lambda n: F.when(is_process, F.col("src_props")[n])
    process = F.struct(F.when(is_process, F.col("src")).alias("guid"), own("image").alias("image"), own("processId").try_cast("int").alias("pid"), own("user").alias("user"), own("computer").alias("computer"))
    seen = lambda *names: (X.parse_time(prop(*names)) * 1e6).cast("long")
    rows = e.select(
        F.col("seq").alias("anchor_seq"),
        F.coalesce(prop("SourceIp", "sourceIp"), "src_node_ip").alias("src_ip"),
        X.coerce_port(prop("SourcePort", "sourcePort")).alias("src_port"),
        F.coalesce(prop("DestinationIp", "destinationIp", "DestIp", "destIp"), "dst_node_ip").alias("dst_ip"),
        X.coerce_port(F.coalesce(prop("DestinationPort", "destinationPort", "DestPort", "destPort"), dst("port"))).alias("dst_port"),
        X.transport(F.coalesce(prop("Protocol", "protocol"), dst("protocol"))).alias("protocol"),
        sessions.alias("sessions"),
        process.alias("process"),
        seen("firstSeen", "FirstSeen", "timestamp").alias("first_us"),
        seen("lastSeen", "LastSeen", "timestamp").alias("last_us"),
    )
    return rows.where("src_ip is not null and dst_ip is not null and dst_port > 0")
