"""Annotated blocks and what holds between the sentences of a document.

Blocks are folded line by line and graphs are packed rows, so all of it is column
expressions; a window holds the sentences of one document.

Defined results: a block without a graph goes; a sentence without an event has no
modal, time or overlap relation; repeated relations stay repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import concept, negative, targets

#: Event pairs of a sentence are made of its first so many events (the operator's own bound).
PAIRED = 8
_STATE = "struct<part:string,sent_id:string,tokens:string,pos:string,english:string,graph:array<string>,alignment:array<string>,document:array<string>>"


def parsed_blocks(blocks: DataFrame) -> DataFrame:
    """(file, sent_id, text, tokens, pos_tags, graph, alignment, document) of blocks (file, block) that have a graph."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("part"), F.lit("").alias("sent_id"), F.lit("").alias("tokens"), F.lit("").alias("pos"), F.lit("").alias("english"), none.alias("graph"), none.alias("alignment"), none.alias("document")).cast(_STATE)

    def after(line: Column, mark: str) -> Column:
        return F.trim(F.substring(line, len(mark) + 1, 1_000_000_000))

    def step(s: Column, raw: Column) -> Column:
        x = F.trim(raw)
        low = F.lower(x)
        mark = F.when(low.startswith("# sentence level"), "graph").when(x.startswith("# alignment"), "alignment").when(low.startswith("# document level annotation"), "document")
        is_id, is_words, is_pos, is_english = x.rlike("^#\\s*:: snt"), x.startswith("Words:"), x.startswith("POS:"), x.startswith("English translation:")
        skip = (x == "") | x.startswith("Word IDs:") | x.startswith("Index:") | mark.isNotNull() | is_id | is_words | is_pos | is_english
        held = lambda name: F.when(~skip & (s["part"] == name), F.concat(s[name], F.array(raw))).otherwise(s[name]).alias(name)
        return F.struct(
            F.coalesce(mark, s["part"]).alias("part"),
            F.when(is_id, F.trim(F.regexp_replace(x, "^#\\s*:: snt", ""))).otherwise(s["sent_id"]).alias("sent_id"),
            F.when(is_words, after(x, "Words:")).otherwise(s["tokens"]).alias("tokens"),
            F.when(is_pos, after(x, "POS:")).otherwise(s["pos"]).alias("pos"),
            F.when(is_english, after(x, "English translation:")).otherwise(s["english"]).alias("english"),
            held("graph"), held("alignment"), held("document"),
        ).cast(_STATE)

    folded = blocks.select("file", F.aggregate(F.split("block", "\r?\n"), start, step).alias("s")).select("file", "s.*")
    words = lambda c: F.filter(F.split(c, "\\s+"), lambda w: w != "")
    text = F.when(F.col("tokens") != "", F.array_join(words("tokens"), " ")).otherwise(F.col("english"))
    rows = folded.select("file", "sent_id", text.alias("text"), words("tokens").alias("tokens"), words("pos").alias("pos_tags"), F.trim(F.array_join("graph", "\n")).alias("graph"), "alignment", "document")
    return rows.filter("graph <> ''")


def attribute_values(graph_text: Column, name: str) -> Column:
    """{variable: value} of an attribute: each value belongs to the last variable declared on its line or before; the last one counts."""
    start = F.struct(F.lit(None).cast("string").alias("var"), F.create_map().cast("map<string,string>").alias("found"))

    def step(s: Column, line: Column) -> Column:
        declared = F.regexp_extract_all(line, F.lit(r"\(([a-zA-Z]\w*)\s*/"), F.lit(1))
        var = F.when(F.size(declared) > 0, F.element_at(declared, -1)).otherwise(s["var"])
        values = F.regexp_extract_all(line, F.lit(rf":{name}\s+([^\s)]+)"), F.lit(1))
        rest = F.map_filter(s["found"], lambda k, v: k != var)
        some = (F.size(values) > 0) & var.isNotNull()
        return F.struct(var.alias("var"), F.when(some, F.map_concat(rest, F.create_map(var, F.element_at(values, -1)))).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.split(graph_text, "\n"), start, step, lambda s: s["found"])


def annotated_relations(document: Column, family: str) -> Column:
    """[(src, rel, tgt)] of one family of a document annotation: the triples inside the parentheses behind its name."""
    behind = F.substring(document, F.instr(document, f":{family}"), 1_000_000_000)
    tokens = F.regexp_extract_all(F.substring(behind, F.instr(behind, "("), 1_000_000_000), F.lit(r"[()]|[^()\s]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (depth == 0).alias("done"), F.concat(s["kept"], F.array(t)).alias("kept")))

    body = F.aggregate(tokens, start, step, lambda s: F.array_join(s["kept"], " "))
    found = F.regexp_extract_all(body, F.lit(r"\( [^()\s]+ :[^()\s]+ [^()\s]+ \)"), F.lit(0))
    triple = lambda x: F.split(x, " ")
    made = F.transform(found, lambda x: F.struct(triple(x)[1].alias("src"), triple(x)[2].alias("rel"), triple(x)[3].alias("tgt")))
    return F.when(F.instr(document, f":{family}") > 0, made).otherwise(F.array().cast("array<struct<src:string,rel:string,tgt:string>>"))


def relations(sentences: DataFrame) -> DataFrame:
    """(doc, src, rel, tgt) of sentences (doc, pos, prefix, top, g): variables get their sentence's prefix.

    The author affirms or denies each event; the document is written after each; events of a
    sentence overlap; ``:time`` after and before; tops follow one another; equal names are one entity."""
    g, named = F.col("g"), lambda c: F.concat(F.col("prefix"), c)
    is_event = lambda c: c.rlike(r"^[a-z][a-z0-9_-]*-[0-9]{2,3}$")
    events = F.transform(F.filter(g, lambda t: (t["role"] == ":instance") & is_event(t["target"])), lambda t: t["source"])
    rows = sentences.withColumn("events", events)
    rel = lambda src, name, tgt: F.struct(src.alias("src"), (F.lit(name) if isinstance(name, str) else name).alias("rel"), tgt.alias("tgt"))
    modal = F.transform("events", lambda e: rel(F.lit("author"), F.when(negative(g, e), ":full-negative").otherwise(":full-affirmative"), named(e)))
    written = F.transform("events", lambda e: rel(F.lit("document-creation-time"), ":before", named(e)))
    first = F.slice("events", 1, PAIRED)
    overlap = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, PAIRED), lambda b: rel(named(a), ":overlap", named(b)))))
    times = F.filter(g, lambda t: (t["role"] == ":time") & concept(g, t["target"]).isin("after", "before") & (F.size(targets(g, t["target"], ":op1")) > 0))
    marked = F.transform(times, lambda t: rel(named(t["source"]), F.concat(F.lit(":"), concept(g, t["target"])), named(F.get(targets(g, t["target"], ":op1"), F.lit(0)))))
    inside = rows.select("doc", F.explode(F.concat(modal, written, overlap, marked)).alias("r")).select("doc", "r.*")
    following = F.lead(named(F.col("top"))).over(Window.partitionBy("doc").orderBy("pos"))
    order = rows.select("doc", named(F.col("top")).alias("src"), F.lit(":before").alias("rel"), following.alias("tgt")).filter("tgt is not null")
    names = F.flatten(F.transform(F.filter(g, lambda t: t["role"] == ":name"), lambda t: F.transform(F.slice(targets(g, t["target"], ":op1"), 1, 1), lambda n: F.struct(named(t["source"]).alias("node"), F.regexp_replace(n, '^"|"$', "").alias("name")))))
    entities = rows.select("doc", "pos", F.posexplode(names).alias("at", "n")).select("doc", "pos", "at", "n.*")
    chain = F.lead("node").over(Window.partitionBy("doc", "name").orderBy("pos", "at"))
    same = entities.select("doc", F.col("node").alias("src"), F.lit(":same-entity").alias("rel"), chain.alias("tgt")).filter("tgt is not null")
    return inside.unionByName(order).unionByName(same)
