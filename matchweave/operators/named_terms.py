"""Matching beyond the lexicon: terms that only a profile names, products that nobody knows, and tools.

1. Profile names and tags are found in lines by an index: a line's words are joined to the first word of each term, and only
   the terms met there are tested as a whole. Lines and terms are the two sides of an equi-join; nothing is compared with all.
2. What a line adds depends on what the posting and the profile have named before: an ordered fold over the few lines of a
   (posting, profile) pair that hold a term of that profile, within the row.
3. Pairs without such a line are scored on what the posting alone says, so the product with the profiles carries no text.

The rules of the fold. Names go before tags on a line. A term that is already asked for isn't asked again, but a line with years
fills its missing years. A tag doesn't open an entry if a specific tag of it was asked for, nothing opens if a word of its name
was asked for, and a term opens at most one entry a line. Where a line opens nothing, capitalised words in it are asked for as
unknown products, if the line is Hebrew or begins like a request for experience.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matcher

# Words and patterns.
GENERIC = (
    "ai", "llm", "ml", "nlp", "api", "ui", "ux", "web", "backend", "frontend", "full stack", "fullstack", "mobile", "cloud", "deploy", "hosting",
    "automation", "devops", "scripting", "oop", "design patterns", "rdbms", "sql", "version control", "source control", "no-code", "cross-platform",
    "javascript backend", "java frontend", "בינה מלאכותית", "בינה-מלאכותית", "אוטומציה", "בסיסי נתונים", "בק-אנד", "ממשק", "סמנטי",
)
UNKNOWN_STOP = (
    "b.sc", "m.sc", "ph.d", "ba", "ma", "b", "sc", "m", "bsc", "msc", "phd", "ph", "d", "ci", "cd", "cicd", "agile", "scrum", "kanban", "tdd", "bdd",
    "jira", "git", "experience", "background", "familiarity", "knowledge", "proficiency", "understanding", "proven", "strong",
)
TOOLS = ("git", "ci/cd", "cicd", "agile", "scrum", "kanban", "microservices", "graphql", "tdd", "bdd", "jira", "linux")
CAPITALISED = r"(?:[A-Z][A-Za-z0-9]*|[A-Z]{2,})(?:[\s-]+(?:[A-Z][A-Za-z0-9]*|[A-Z]{2,})){0,3}"
HEBREW = "[֐-׿]"
REQUEST = (
    r"(?i)^[-*•\s]*(experience (with|in|building|integrating|deploying|working)|familiarity with|knowledge of|background in|proficiency in"
    r"|proven experience (with|in|building)?|strong (background|experience) (with|in)|understanding of)($|[^A-Za-z0-9_])"
)
POINTS_TOOL = 4.0
#: Bullets of a score: so many for, so many against, so many in all.
FOR, AGAINST, BULLETS = 3, 2, 4
NAME_PARTS = r"[\s.\-/]+"


def flattened(profiles: DataFrame) -> DataFrame:
    """profile_id, seq, domain, tech, industry, personal, weight, tags: the entries of nested profiles (``experience``: map of
    domain to map of tech to struct<industry_years, personal_years, personal_weight, search_tags>) in the order they are written.
    Null maps and entries give no rows; a null entry of a known name gives a row without years."""
    domains = profiles.select("profile_id", F.posexplode("experience").alias("d", "domain", "techs"))
    rows = domains.select("profile_id", "d", "domain", F.posexplode("techs").alias("t", "tech", "e"))
    order = F.row_number().over(Window.partitionBy("profile_id").orderBy("d", "t"))
    return rows.select(
        "profile_id", order.alias("seq"), "domain", "tech", F.col("e.industry_years").alias("industry"), F.col("e.personal_years").alias("personal"), F.col("e.personal_weight").alias("weight"), F.coalesce("e.search_tags", F.array().cast("array<string>")).alias("tags")
    )


def term_pattern(term: Column) -> Column:
    """``matcher.term_pattern`` of a column of terms in lower case; terms with Hebrew letters or without Latin ones count anywhere."""
    escaped = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\#-])", r"\\$1")
    left = F.when(term.rlike("^[a-z0-9]"), "(^|[^a-z0-9.])").otherwise("")
    right = F.when(~term.rlike("[a-z0-9]$"), "").when(term.endswith("s"), "([^a-z0-9]|$)").otherwise("s?([^a-z0-9]|$)")
    return F.when(term.rlike(HEBREW) | ~term.rlike("[a-z0-9]"), escaped).otherwise(F.concat(left, escaped, right))


def term_hits(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """The columns of ``lines`` (but low, the line in lower case) with each of the ``terms`` (term, in lower case) it holds."""
    others = [c for c in lines.columns if c != "low"]
    known = terms.select("term").where("term IS NOT NULL AND term <> ''").distinct().withColumn("pattern", term_pattern(F.col("term")))
    anchored = known.where(F.col("term").rlike("[a-z0-9]") & ~F.col("term").rlike(HEBREW))
    # the first word of a term stands in the line as a word, or with a plural s if the term is that word
    head = F.regexp_extract("term", "[a-z0-9]+", 0)
    anchored = anchored.select("term", "pattern", F.explode(F.when(F.col("term").rlike("^[^a-z0-9]*[a-z0-9]+$"), F.array(head, F.concat(head, F.lit("s")))).otherwise(F.array(head))).alias("head"))
    words = lines.select("*", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("head"))
    met = words.join(anchored, "head").where(F.rlike(F.col("low"), F.col("pattern"))).select(*others, "term")
    # terms in Hebrew count within words: only lines in Hebrew are looked at, by an inequality join
    met = met.union(lines.where(F.col("low").rlike(HEBREW)).join(known.where(F.col("term").rlike(HEBREW)).select("term"), F.contains("low", "term")).select(*others, "term"))
    # so do terms without Latin or Hebrew letters (other scripts, signs): a line's characters of that kind are joined to their first one
    first = "[^a-z0-9֐-׿]"
    bare = known.where(~F.col("term").rlike(f"[a-z0-9]|{HEBREW}")).select("term", F.regexp_extract("term", first, 0).alias("head"))
    signs = lines.select("*", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(first), F.lit(0)))).alias("head"))
    met = met.union(signs.join(bare, "head").where(F.contains("low", "term")).select(*others, "term"))
    return met.distinct()


def unknown_terms(line: Column) -> Column:
    """The capitalised terms of a line that may be products, in order, with repeats."""
    told = F.regexp_extract_all(line, F.lit(rf"(?:^|[^A-Za-z0-9_])({CAPITALISED})(?![A-Za-z0-9_])"), F.lit(1))
    low, one = F.lower, lambda x: F.when((F.length(x) > 3) & x.endswith("s"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    stop, generic = F.array(*map(F.lit, UNKNOWN_STOP)), F.array(*map(F.lit, GENERIC))
    kept = F.filter(told, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, low(t)) & ~F.array_contains(generic, low(t)) & ~F.array_contains(generic, one(low(t))))
    return F.when(line.rlike(HEBREW) | line.rlike(REQUEST), kept).otherwise(F.array().cast("array<string>"))


def _entry_terms(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries with key, specific (tags that identify them) and words (of the name), and their terms: profile_id, seq, nth
    (0: the name), term."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    known = entries.where("tech IS NOT NULL").select("profile_id", "seq", "domain", F.lower("tech").alias("key"), F.array_except(F.array_distinct(tags), F.array(*map(F.lit, GENERIC))).alias("specific"))
    known = known.withColumn("words", F.split("key", NAME_PARTS))
    terms = known.select("profile_id", "seq", F.posexplode(F.concat(F.array("key"), "specific")).alias("nth", "term"))
    return known, terms.where("term IS NOT NULL AND term <> ''")


def candidates(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """posting_id, profile_id, cands: for each pair with a line that holds a name or tag of the profile, these lines' entries in
    the order in which they are read. ``lines``: posting_id, place, low, bucket, years, industry, any_of."""
    known, terms = _entry_terms(entries)
    hits = term_hits(lines, terms).join(terms, "term")
    by_entry = hits.groupBy("posting_id", "profile_id", "place", "seq", "bucket", "years", "industry", "any_of").agg(F.sort_array(F.collect_set(F.struct("nth", "term"))).alias("met"))
    told = by_entry.join(known, ["profile_id", "seq"])
    named = F.filter(F.transform("met", lambda m: F.when(m["nth"] == 0, m["term"])), lambda t: t.isNotNull())
    every = F.transform("met", lambda m: m["term"])
    rest = [F.col(c) for c in ("key", "domain", "specific", "words", "bucket", "years", "industry", "any_of")]
    passes = F.array(*[F.struct("place", F.lit(k).alias("tags"), "seq", *rest, options.alias("options")) for k, options in ((0, named), (1, every))])
    return told.groupBy("posting_id", "profile_id").agg(F.sort_array(F.flatten(F.collect_list(passes))).alias("cands"))


def extended(rows: DataFrame) -> DataFrame:
    """``rows`` (as from ``matcher.read`` with unknown, and cands) with reqs and also as they are with the profile's terms and the
    unknown ones."""
    first = lambda arr: F.get(arr, F.lit(0))

    def open_(opened: Column, c: Column) -> Column:
        seen = lambda w: F.exists("reqs", lambda r: (r["place"] <= c["place"]) & (r["tech"] == w)) | F.exists(opened, lambda o: o["tech"] == w)
        claimed = lambda t: F.exists("reqs", lambda r: (r["place"] == c["place"]) & (r["tech"] == t)) | F.exists(opened, lambda o: (o["place"] == c["place"]) & (o["term"] == t))
        term = first(F.filter(c["options"], lambda t: ~claimed(t)))
        may = ~seen(c["key"]) & ((c["tags"] == 0) | ~F.exists(c["specific"], seen)) & ~F.exists(c["words"], seen) & term.isNotNull()
        new = F.struct(
            c["key"].alias("tech"), c["domain"].alias("domain"), (c["bucket"] == "required").alias("required"), c["place"].alias("place"), c["years"].alias("years"), c["industry"].alias("industry"), c["any_of"].alias("any_of"),
            (F.lit(1000) * (c["tags"] + 1) + c["seq"]).cast("int").alias("rank"), F.when(c["years"].isNotNull(), c["place"]).alias("since"), c["industry"].alias("own_industry"), term.alias("term"),
        )
        return F.when(may, F.concat(opened, F.array(new))).otherwise(opened)

    kind = rows.schema["reqs"].dataType.simpleString().removesuffix(">>") + ",term:string>>"
    rows = rows.withColumn("opened", F.aggregate("cands", F.array().cast(kind), open_))
    fields = ("tech", "domain", "required", "place", "years", "industry", "any_of", "rank", "since", "own_industry")
    # a word that the profile names first is its entry from there on, though the lexicon knows it too
    rows = rows.withColumn("reqs", F.concat(F.filter("reqs", lambda r: ~F.exists("opened", lambda o: o["tech"] == r["tech"])), F.transform("opened", lambda o: F.struct(*[o[f].alias(f) for f in fields]))))
    later = lambda r: first(F.filter("cands", lambda c: (c["tags"] == 0) & (c["key"] == r["tech"]) & (c["place"] >= r["place"]) & c["years"].isNotNull() & (r["since"].isNull() | (c["place"] < r["since"]))))
    rows = rows.withColumn("reqs", F.transform("reqs", lambda r: F.struct(r.alias("r"), later(r).alias("f"))))
    replaced = lambda x, f: F.when(x["f"].isNull(), x["r"][f]).otherwise(x["f"]["years"] if f == "years" else x["r"]["own_industry"] | x["f"]["industry"])
    rows = rows.withColumn("reqs", F.transform("reqs", lambda x: F.struct(*[(replaced(x, f) if f in ("years", "industry") else x["r"][f]).alias(f) for f in fields])))
    used = F.transform(F.filter("cands", lambda c: F.exists("reqs", lambda r: (r["tech"] == c["key"]) & (r["place"] <= c["place"]))), lambda c: c["place"])

    # unknown terms of lines that open nothing
    free = F.filter("lines", lambda x: (F.size(x["unknown"]) > 0) & ~F.exists("reqs", lambda r: r["place"] == x["place"]))
    one = lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    asked = lambda t, x: F.exists("reqs", lambda r: (r["place"] <= x["place"]) & ((r["tech"] == t) | (r["tech"] == one(t))))
    of_line = lambda x: F.transform(F.filter(F.transform(x["unknown"], lambda t: F.lower(t)), lambda t: ~asked(t, x)), lambda t, i: F.struct(t.alias("tech"), x.alias("x"), i.alias("rank")))
    rows = rows.withColumn("strange", F.flatten(F.transform(free, of_line)))
    once = F.filter("strange", lambda s, i: F.array_position(F.transform("strange", lambda q: q["tech"]), s["tech"]) == i + 1)
    unknown = F.transform(
        once,
        lambda s: F.struct(
            s["tech"].alias("tech"), F.lit(None).cast("string").alias("domain"), (s["x"]["bucket"] == "required").alias("required"), s["x"]["place"].alias("place"), s["x"]["years"].alias("years"), s["x"]["industry"].alias("industry"),
            s["x"]["any_of"].alias("any_of"), s["rank"].alias("rank"), F.when(s["x"]["years"].isNotNull(), s["x"]["place"]).alias("since"), s["x"]["industry"].alias("own_industry"),
        ),
    )
    rows = rows.withColumns({"also": F.concat(used, F.transform(unknown, lambda u: u["place"])), "unknown": unknown})
    keys = F.concat(F.transform("reqs", lambda r: r["tech"]), F.transform("unknown", lambda u: F.concat(F.lit("unk:"), u["tech"])))
    counted = F.flatten(F.transform(keys, lambda k: F.concat(F.array(k), F.split(k, NAME_PARTS))))
    rows = rows.withColumn("tools", F.array_except("tools", counted))
    ordered = F.sort_array(F.transform(F.concat("reqs", "unknown"), lambda r: F.struct(r["place"].alias("a"), r["rank"].alias("b"), r["tech"].alias("c"), r.alias("r"))))
    return rows.withColumn("reqs", F.transform(ordered, lambda s: s["r"]))


def tool_rows(entries: DataFrame, tools: DataFrame) -> DataFrame:
    """profile_id, has_tools, held_tools, tool_tags: whether a profile lists tools at all, the tools it has whatever a posting says
    (found, or named by an entry), and the tags that count if a posting holds them. ``tools``: profile_id, tool, found, tags."""
    told = tools.select("profile_id", "tool", F.coalesce("found", F.lit(False)).alias("found"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t)).alias("tags"))
    slim = F.explode(F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(k.replace("/", "")).alias("slim")) for k in TOOLS]))
    known = told.select("*", slim.alias("k")).where((F.col("tool") == F.col("k.kw")) | (F.col("tool") == F.col("k.slim")))
    # a tool's own name goes before its name without the slash
    known = known.groupBy("profile_id", "k.kw").agg(F.max(F.struct(F.col("tool") == F.col("k.kw"), "found", "tags")).alias("t"))
    by_tool = known.groupBy("profile_id").agg(F.collect_set(F.when(F.col("t.found"), F.col("kw"))).alias("found"), F.map_from_entries(F.collect_list(F.struct("kw", "t.tags"))).alias("tool_tags"))
    names = F.concat(F.array(F.lower("tech")), F.split(F.lower("tech"), NAME_PARTS), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t)))
    by_entry = entries.where("tech IS NOT NULL").select("profile_id", F.explode(F.array_intersect(names, F.array(*map(F.lit, TOOLS)))).alias("kw")).groupBy("profile_id").agg(F.collect_set("kw").alias("named"))
    every = tools.select("profile_id").distinct().withColumn("has_tools", F.lit(True))
    out = every.join(by_tool, "profile_id", "left").join(by_entry, "profile_id", "full_outer")
    none = F.array().cast("array<string>")
    return out.select("profile_id", F.coalesce("has_tools", F.lit(False)).alias("has_tools"), F.array_union(F.coalesce("found", none), F.coalesce("named", none)).alias("held_tools"), F.coalesce("tool_tags", F.create_map().cast("map<string,array<string>>")).alias("tool_tags"))


def _tops() -> Column:
    """The best member of each entry of told, the names of all and whether there are several."""
    best = lambda g: F.array_max(F.transform(g["members"], lambda m: F.struct(m["held"], m["ratio"], (-F.array_position(g["members"], m)).alias("o"), m.alias("m"))))["m"]
    return F.transform("told", lambda g: F.struct(best(g).alias("m"), F.array_join(F.transform(g["members"], lambda x: x["tech"]), "/").alias("names"), (F.size(g["members"]) > 1).alias("several")))


def _said() -> Column:
    """What each entry of tops says, in the order of reading: struct<good, text>, from the columns tops and total."""
    pct = lambda m: F.round(m["ratio"] * 100).cast("int").cast("string")
    say = lambda code, *parts: F.concat_ws(":", F.lit(code), *parts)

    def bullet(g: Column) -> Column:
        m, several, names = g["m"], g["several"], g["names"]
        term = (
            F.when(~m["required"], F.when(m["held"], F.struct(F.lit(True).alias("good"), say("plus", m["tech"]).alias("text"))))
            .when(several & m["held"], F.struct(F.lit(True).alias("good"), say("ok", m["tech"], pct(m)).alias("text")))
            .when(~m["held"] & (m["ratio"] >= 0.15), F.struct(F.lit(True).alias("good"), say("akin", names, pct(m)).alias("text")))
            .when(~m["held"], F.struct(F.lit(False).alias("good"), say("miss", names).alias("text")))
            .when(m["ratio"] >= 0.85, F.struct(F.lit(True).alias("good"), say("ok", m["tech"], pct(m)).alias("text")))
            .when(~m["asks"] | (m["ratio"] >= 0.5), F.struct(F.lit(True).alias("good"), say("part", m["tech"], pct(m)).alias("text")))
            .otherwise(F.struct(F.lit(False).alias("good"), say("short", m["tech"], pct(m)).alias("text")))
        )
        code = F.when(m["ratio"] >= 0.85, "ok").when(m["ratio"] >= 0.5, "part").otherwise("short")
        category = F.when(m["around"], F.when(~m["required"], F.struct(F.lit(True).alias("good"), say("plus", m["domain"]).alias("text"))).otherwise(F.struct((m["ratio"] >= 0.5).alias("good"), F.concat_ws(":", code, m["domain"], pct(m)).alias("text")))).when(
            m["required"], F.struct(F.lit(False).alias("good"), say("miss", m["domain"]).alias("text"))
        )
        role = F.struct(m["around"].alias("good"), F.concat_ws(":", F.when(m["around"], "ok").otherwise("miss"), m["domain"]).alias("text"))
        total = F.when(F.col("total") > 0, F.struct((m["ratio"] >= 0.9).alias("good"), F.concat_ws(":", F.when(m["ratio"] >= 0.9, "ok").otherwise("short"), F.lit("years"), pct(m)).alias("text")))
        return F.when(m["kind"] == "term", term).when(m["kind"] == "category", category).when(m["kind"] == "role", role).when(m["kind"] == "total", total)

    def terms(several: bool, required: bool) -> Column:
        return F.filter("tops", lambda g: (g["m"]["kind"] == "term") & (g["several"] == several) & (g["m"]["required"] == required))

    other = F.filter("tops", lambda g: g["m"]["kind"] != "term")
    return F.filter(F.transform(F.concat(terms(False, True), terms(True, True), terms(False, False), other), bullet), lambda b: b.isNotNull())


def _bullets() -> Column:
    """At most three strings for and two against, four in all, as code:item or code:item:percent, from the columns said, tops and
    hit_tools."""
    none = F.filter(F.array(F.when(~F.exists("tops", lambda g: g["m"]["kind"] == "term"), "weak:no terms")), lambda b: b.isNotNull())
    good = F.concat(none, F.transform(F.filter("said", lambda b: b["good"]), lambda b: b["text"]), F.transform("hit_tools", lambda t: F.concat(F.lit("ok:"), t)))
    bad = F.transform(F.filter("said", lambda b: ~b["good"]), lambda b: b["text"])
    return F.slice(F.concat(F.slice(good, 1, FOR), F.slice(bad, 1, AGAINST)), 1, BULLETS)


def scores(postings: DataFrame, entries: DataFrame, summary: DataFrame, tools: DataFrame) -> DataFrame:
    """profile_id, posting_id, score, matched, missing, bullets for every pair of ``postings`` (posting_id, text) and profiles.

    ``entries``: profile_id, seq (order within the profile), domain, tech, industry, personal, weight, tags; ``summary``: profile_id,
    total_years, domain_years if known; ``tools``: profile_id, tool, found, tags. Null or empty postings have the least score.
    Postings of the same text are read and scored once."""
    return matcher.once_a_text(postings, lambda texts: _scores(texts, entries, summary, tools))


def _scores(postings: DataFrame, entries: DataFrame, summary: DataFrame, tools: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    said = F.filter(F.array(*[F.when(text.rlike(matcher.term_pattern(t)), t) for t in TOOLS]), lambda t: t.isNotNull())
    by_text = postings.select("posting_id", said.alias("tools"))
    tagged = term_hits(postings.select("posting_id", text.alias("low")), tools.select(F.explode("tags").alias("t")).select(F.lower("t").alias("term"))).groupBy("posting_id").agg(F.collect_set("term").alias("said_tags"))
    rows = matcher.read(postings, low=F.col("low"), unknown=unknown_terms(F.col("line"))).join(by_text, "posting_id").join(tagged, "posting_id", "left")
    rows = rows.withColumn("said_tags", F.coalesce("said_tags", F.array().cast("array<string>")))
    lines = rows.select("posting_id", F.explode("lines").alias("x")).select("posting_id", *[F.col(f"x.{c}").alias(c) for c in ("place", "low", "bucket", "years", "industry", "any_of")])
    own = candidates(lines, entries)
    people = matcher.profiles(entries, summary).join(tool_rows(entries, tools), "profile_id", "left")
    people = people.withColumns({"has_tools": F.coalesce("has_tools", F.lit(False)), "held_tools": F.coalesce("held_tools", F.array().cast("array<string>"))})
    kept = ("posting_id", "blank", "weight", "groups", "tools", "said_tags")
    # pairs with a term of their own are read again with it; all others share what the posting says alone
    special = matcher.with_entries(extended(rows.join(own, "posting_id"))).select("profile_id", *kept).join(people, "profile_id")
    taken = own.groupBy("posting_id").agg(F.collect_set("profile_id").alias("skip"))
    kind = own.schema["cands"].dataType.simpleString()
    plain = matcher.with_entries(extended(rows.withColumn("cands", F.array().cast(kind)))).select(*kept).join(taken, "posting_id", "left")
    plain = plain.crossJoin(people).where(F.col("skip").isNull() | ~F.array_contains("skip", F.col("profile_id"))).drop("skip")
    pairs = special.unionByName(plain)
    hit = F.filter("tools", lambda t: F.array_contains("held_tools", t) | F.coalesce(F.arrays_overlap(F.try_element_at("tool_tags", t), "said_tags"), F.lit(False)))
    pairs = pairs.withColumn("hit_tools", hit)
    n_hit, n_all = F.size("hit_tools"), F.size("tools")
    pairs = pairs.withColumns({"extra_earned": n_hit * POINTS_TOOL, "extra_weight": F.when(F.col("has_tools"), n_all).otherwise(n_hit) * POINTS_TOOL})
    rated = matcher.rated(pairs, "total", "hit_tools").withColumn("tops", _tops()).withColumn("said", _said())
    return rated.select("profile_id", "posting_id", "score", "matched", "missing", _bullets().alias("bullets"))
