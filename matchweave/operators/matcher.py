"""Matching of free-text postings against profiles: sections, requirements and an explainable score.

A posting's meaning is in the order of its lines. Lines are exploded once; sections are a carried mark; a requirement is the
first mention of a term, whose missing years a later mention fills in. What a posting is scored on is gathered into one row
a posting (bounded by its text), which meets the (broadcast) profiles; a pair is scored within its row, so nothing is
shuffled after that product.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms by domain.
LEXICON = {
    "backend": (
        "java", "c#", ".net", "python", "ruby", "go", "golang", "rust", "php", "scala", "kotlin", "node.js", "nodejs", "spring boot", "django",
        "flask", "fastapi", "express", "nestjs", "mongodb", "redis", "elasticsearch", "hibernate", "spring", "rest", "restful", "soap", "grpc", "orm",
        "graphql", "laravel", "symfony", "asp.net", "microservices", "jpa", "openapi", "xml",
    ),
    "frontend": (
        "react", "react.js", "vue", "vue.js", "angular", "svelte", "next.js", "nextjs", "javascript", "typescript", "html", "css", "tailwind css",
        "sass", "webpack", "jquery", "bootstrap", "redux", "material ui", "jsx",
    ),
    "ai_ml_llm": (
        "machine learning", "deep learning", "tensorflow", "pytorch", "langchain", "openai", "llm", "nlp", "hugging face", "scikit-learn", "keras",
        "large language models", "vision language models", "vlm", "vlms", "fine-tuning", "fine tuning", "reinforcement learning",
        "multi-agent systems", "multi-agent",
    ),
    "data_bi": (
        "sql", "postgresql", "postgres", "mysql", "spark", "hadoop", "pandas", "numpy", "power bi", "tableau", "looker", "dbt", "airflow", "kafka",
        "cassandra", "etl", "big data", "snowflake", "redshift",
    ),
    "devops_cloud": (
        "docker", "kubernetes", "k8s", "aws", "azure", "gcp", "terraform", "ansible", "jenkins", "github actions", "gitlab", "dynamodb", "linux",
        "nginx", "apache", "puppet", "chef", "circleci", "prometheus", "grafana", "vagrant", "kerberos", "jwt", "jwe", "oauth", "oauth1", "oauth2",
        "yaml",
    ),
    "mobile": (
        "swift", "objective-c", "flutter", "react native", "android", "ios", "xamarin", "cordova", "ionic",
    ),
    "other_domains": (
        "penetration testing", "siem", "selenium", "cypress", "jest", "pytest", "junit", "mocha", "appium", "ros", "robotics", "embedded",
    ),
}
# Keywords, patterns, weights.
SECOND_DOMAIN = {"postgresql": "backend", "postgres": "backend", "mysql": "backend", "sql": "backend", "android": "mobile", "ios": "mobile"}
GUARDS = {
    "go": r"golang|programming|language|developer|engineer|backend|microservice|python|java([^a-z]|$)|rust|kotlin|scala|c\+\+|c#|פיתוח|שפת|שפות",
    "express": r"express\.?js|express\s+js|node",
}
CATEGORIES = {
    "backend": ("backend", "back-end", "back end", "server-side", "server side", "צד שרת", "פיתוח שרת"),
    "frontend": ("frontend", "front-end", "front end", "client-side", "client side", "צד לקוח"),
    "fullstack": ("full stack", "full-stack", "fullstack", "פולסטאק", "פול סטאק"),
    "ai_ml_llm": ("artificial intelligence", "machine learning", "generative ai", "gen ai", "genai", "בינה מלאכותית", "למידת מכונה"),
    "data_bi": ("data engineering", "data analysis", "הנדסת נתונים", "ניתוח נתונים"),
    "devops_cloud": ("devops", "infrastructure", "ענן", "אינפרה"),
    "mobile": ("mobile development", "mobile apps", "פיתוח מובייל", "אפליקציות מובייל"),
}
ROLES = {
    "backend": ("backend", "back-end", "server-side", "server side"),
    "frontend": ("frontend", "front-end", "client-side", "ui developer"),
    "fullstack": ("full stack", "full-stack", "fullstack"),
    "devops_cloud": ("devops", "devsecops", "platform engineer", "sre", "infrastructure"),
    "ai_ml_llm": ("machine learning", "ml engineer", "ai engineer", "llm", "nlp"),
    "data_bi": ("data engineer", "data analyst", "bi developer", "data scientist"),
    "mobile": ("mobile developer", "ios developer", "android developer"),
    "other_domains": ("qa engineer", "sdet", "security engineer", "cyber"),
}
ADVANTAGE_HEADER = r"(?i)(יתרון|advantage|nice[ -]?to[ -]?have|preferred qualifications?|bonus points?|desirable|beneficial|a plus)"
REQUIREMENT_HEADER = (
    r"(?i)(requirements?|דרישות|חובה|must[ -]?have|qualifications?|essential|mandatory|what you(?:'|’)?ll need|what we(?:'|’)?re looking for"
    r"|what you(?:'|’)?ll do|responsibilities|the role|תיאור המשרה|על התפקיד|תחומי אחריות)"
)
CONTEXT_HEADER = r"(?i)(אודות|על החברה|מי אנחנו|קצת עלינו|למה לעבוד|הטבות|about (?:us|the company)|who we are|our (?:story|team|benefits)|perks|benefits)"
ADVANTAGE_PHRASE = r"(?i)(יתרונות|יתרון(?:\s+משמעותי)?|advantages?|nice[ -]?to[ -]?have|preferred qualifications?|bonus points?|desirable|beneficial|a plus|נחשב(?:ים)?|ל?יתרון)"
ADVANTAGE_SUFFIX = r"(?i)(?:^|[\s(\-–—])(יתרון(?:\s+משמעותי)?|a plus|an advantage|advantage|nice to have|preferred|bonus)\s*[).!]?\s*$"
REQUIRED_SUFFIX = r"(?i)(?:^|[\s(\-–—])(חובה|must(?:\s+have)?|required)\s*[).!]?\s*$"
INDUSTRY_ONLY = r"(?i)(בתעשייה|ניסיון תעשייתי|industry experience|commercial experience|production environment|hands[ -]on (?:industry|commercial))"
UNIT = r"(?:years?|yrs?|שנים|שנות|שנה|שנ['׳])"
YEAR_RANGE = r"(\d+(?:\.\d+)?)\s*(?:[-–—]|עד|to)\s*(?:\d+(?:\.\d+)?)\s*\+?\s*" + UNIT
YEARS = r"(\d+(?:\.\d+)?)\s*\+?\s*" + UNIT
ANY_OF = r"(אחת|אחד) או יותר|לפחות (אחת|אחד)|one or more|at least one|one of the following| או |, or | or "
CATEGORY_CONTEXT = r"(?i)(ניסיון|רקע|היכרות|experience|background|proficien|expertise|knowledge)"
ROLE_CONTEXT = r"(?i)(developer|engineer|engineering|development|programmer|architect|team lead|position|role|מפתח|מפתחת|מהנדס|מהנדסת|פיתוח|תפקיד|משרה|ארכיטקט)"
TOTAL_YEARS = (
    r"(\d+(?:\.\d+)?)\s*\+?\s*years?\s+(?:of\s+)?(?:[a-z][a-z-]*\s+){0,3}experience",
    r"(\d+(?:\.\d+)?)\s*\+?\s*שנות\s+ניסיון",
    r"ניסיון\s+של\s+(\d+(?:\.\d+)?)\s*שנ",
    r"experience\s*(?:of\s*)?(\d+(?:\.\d+)?)\s*\+?\s*years?",
)
YEAR_WORDS = (
    ("שנתיים", "2 שנים"), ("שלוש שנים", "3 שנים"), ("ארבע שנים", "4 שנים"), ("חמש שנים", "5 שנים"), ("שש שנים", "6 שנים"), ("שבע שנים", "7 שנים"),
    ("שמונה שנים", "8 שנים"), ("תשע שנים", "9 שנים"), ("עשר שנים", "10 שנים"), ("שנה אחת", "1 שנים"), ("שנה לפחות", "1 שנים לפחות"),
)
POINTS_WITH_YEARS, POINTS_WITHOUT, POINTS_CATEGORY, POINTS_ROLE, POINTS_TOTAL = 10.0, 12.0, 8.0, 8.0, 15.0
ADVANTAGE_SHARE, CONSOLATION, PRESENCE, PRESENCE_FROM, CURVE = 0.4, 0.35, 0.7, 0.5, 1.5
LEAST, MOST, NO_SIGNAL = 18, 94, 40
PERSONAL_WEIGHT, PERSONAL_WEIGHT_BY_DOMAIN = 50, {"ai_ml_llm": 75}

DOMAIN_OF = {term: domain for domain, terms in LEXICON.items() for term in terms}


def term_pattern(term: str) -> str:
    """A term as a whole word, a plural s allowed; without look-around, so that other engines can run it."""
    escaped = re.sub(r"([.*+?^${}()|\[\]\\#-])", r"\\\1", term)
    left = r"(^|[^a-z0-9.])" if term[0].isalnum() else ""
    right = (r"([^a-z0-9]|$)" if term.endswith("s") else r"s?([^a-z0-9]|$)") if term[-1].isalnum() else ""
    return left + escaped + right


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def section_lines(postings: DataFrame) -> DataFrame:
    """posting_id, line_no, line, bucket: required, advantage or context. Without a requirements header the context is required."""
    return told_lines(postings).drop("low", "solid")


def told_lines(postings: DataFrame) -> DataFrame:
    """``section_lines`` with low, the line in lower case with year words as numbers, and solid, whether it isn't blank. They
    are made before the windows, so they are columns for all that reads them, never expressions copied into each."""
    low = F.lower("line")
    for word, number in YEAR_WORDS:
        low = F.replace(low, F.lit(word), F.lit(number))
    # postings are dealt once, before their lines are looked at; windows, groups and joins by posting all keep that
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select("posting_id", "text").repartition(tasks, "posting_id")
    lines = dealt.select("posting_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    lines = lines.withColumns({"t": _trimmed(F.col("line")), "low": low})
    t = F.col("t")
    short = (F.length(t) > 0) & (F.length(t) <= 60)
    residue = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[-•*·◦\s]+", ""), ADVANTAGE_PHRASE, ""), r"[:：().!\-–—,\s]+", "")
    advantage = short & t.rlike(ADVANTAGE_HEADER) & (F.length(residue) <= 6)
    words = F.size(F.split(F.regexp_replace(t, r"^[-•*·]\s*", ""), r"\s+"))
    header = short & (t.rlike(r"[:：]\s*$") | (words <= 4))
    mark = F.when(advantage, "advantage").when(header & t.rlike(REQUIREMENT_HEADER), "required").when(header & t.rlike(CONTEXT_HEADER), "context")
    w = Window.partitionBy("posting_id").orderBy("line_no")
    whole = Window.partitionBy("posting_id")
    rows = lines.withColumn("mark", mark)
    state = F.coalesce(F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("context"))
    rows = rows.withColumns({"state": state, "saw": F.coalesce(F.max(F.col("mark").isin("advantage", "required")).over(whole), F.lit(False))})
    inline = F.when(F.col("mark").isNotNull() | (F.length(t) == 0) | (F.col("state") == "context"), None).when(t.rlike(REQUIRED_SUFFIX), "required").when(t.rlike(ADVANTAGE_SUFFIX), "advantage")
    bucket = F.coalesce(inline, F.col("state"))
    bucket = F.when(F.col("saw"), bucket).otherwise(F.when(bucket == "context", "required").otherwise(bucket))
    return rows.select("posting_id", "line_no", "line", bucket.alias("bucket"), "low", (F.length("t") > 0).alias("solid"))


def line_facts(lines: DataFrame, context: bool = False) -> DataFrame:
    """The lines (as from ``told_lines``) that can hold requirements (``context``: all) with what each says: place (required
    lines first), years, industry, any_of, terms."""
    years = F.coalesce(F.nullif(F.regexp_extract("low", YEAR_RANGE, 1), F.lit("")), F.nullif(F.regexp_extract("low", YEARS, 1), F.lit(""))).cast("double")
    rows = lines if context else lines.where((F.col("bucket") != "context") & F.col("solid"))
    # the pattern runs only where the term occurs at all
    lexicon = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(term_pattern(n)).alias("pattern")) for n in DOMAIN_OF])
    terms = F.transform(F.filter(lexicon, lambda x: F.contains(F.col("low"), x["term"]) & F.rlike(F.col("low"), x["pattern"])), lambda x: x["term"])
    place = F.when(F.col("bucket") == "required", 0).otherwise(1 << 20) + F.col("line_no")
    return rows.withColumns(
        {
            "place": place,
            "years": years,
            "industry": F.col("line").rlike(INDUSTRY_ONLY),
            "any_of": F.col("low").rlike(ANY_OF),
            "terms": terms,
        }
    )


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def requirements(facts: DataFrame) -> DataFrame:
    """posting_id, tech, domain, section, place, years, industry, grp (place of an either-or line with two or more of them)."""
    hits = facts.select("posting_id", "bucket", "place", "years", "industry", "any_of", "low", F.explode("terms").alias("tech"))
    guard = F.lit(True)
    for tech, pattern in GUARDS.items():
        guard = guard & ((F.col("tech") != tech) | F.col("low").rlike(pattern))
    by_term = Window.partitionBy("posting_id", "tech")
    hits = hits.withColumn("first", F.min(F.when(guard, F.col("place"))).over(by_term)).where("place >= first")
    filled = F.min(F.when(F.col("years").isNotNull(), F.struct("place", "years", "industry"))).alias("filled")
    reqs = hits.groupBy("posting_id", "tech").agg(F.min("first").alias("place"), F.max(F.when(F.col("place") == F.col("first"), F.struct("bucket", "any_of", "industry"))).alias("own"), filled)
    reqs = reqs.select("posting_id", "tech", F.col("own.bucket").alias("section"), "place", F.col("filled.years").alias("years"), (F.col("own.industry") | F.coalesce("filled.industry", F.lit(False))).alias("industry"), "own.any_of")
    on_line = F.count("*").over(Window.partitionBy("posting_id", "place"))
    grp = F.when((on_line >= 2) & F.col("any_of"), F.col("place"))
    domain = F.element_at(_literal_map(DOMAIN_OF), F.col("tech"))
    return reqs.select("posting_id", "tech", domain.alias("domain"), "section", "place", "years", "industry", grp.alias("grp"))


def _found(keywords: dict[str, tuple[str, ...]], text: Column, whole: bool) -> Column:
    """The keys that ``text`` has a keyword of. ``whole``: ASCII keywords count as whole words only."""
    tests = []
    for key, words in keywords.items():
        plain = [w for w in words if not (whole and key != "fullstack" and w[0].isascii())]
        said = F.exists(F.array(*map(F.lit, plain)), lambda w: F.contains(text, w)) if plain else F.lit(False)
        if len(plain) < len(words):
            said = said | text.rlike("|".join(term_pattern(w) for w in words if w not in plain))
        tests.append(F.when(said, key))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def _first(rows: Column, keep) -> Column:
    return F.get(F.filter(rows, keep), F.lit(0))


def parsed(postings: DataFrame) -> DataFrame:
    """posting_id, blank, weight, groups: array<struct<w, members: array<struct<kind, tech, domain, required, years, industry>>>>:
    what each posting is scored on. Members of an either-or group share an entry; w are its points, weight all of them.

    A posting's solid lines become one array, and requirements, categories, roles and total years are read off it within
    the row: its size is that of the posting, and nothing moves after the postings have been dealt."""
    return with_entries(read(postings).withColumn("also", F.array().cast("array<int>"))).select("posting_id", "blank", "weight", "groups")


def read(postings: DataFrame, **more: Column) -> DataFrame:
    """posting_id, all and lines (structs of the solid lines in order; ``lines`` without context), title (number of the second
    of them) and reqs: what the lexicon finds, as struct<tech, domain, required, place, years, industry, any_of, rank,
    since (place of the line with the years), own_industry>.
    ``more``: further fields of a line, from line, low and the columns of ``line_facts``."""
    low = F.col("low")
    facts = line_facts(told_lines(postings.withColumn("text", F.coalesce("text", F.lit("")))), context=True)
    guard = {tech: low.rlike(pattern) for tech, pattern in GUARDS.items()}
    opening = F.array_except("terms", F.filter(F.array(*[F.when(~ok, tech) for tech, ok in guard.items()]), lambda x: x.isNotNull()))
    asks_category = F.col("years").isNotNull() | F.col("line").rlike(CATEGORY_CONTEXT)
    total = F.coalesce(*[F.nullif(F.regexp_extract("low", p, 1), F.lit("")) for p in TOTAL_YEARS]).cast("double")
    line = {
        "place": F.col("place"),
        "line_no": F.col("line_no"),
        "bucket": F.col("bucket"),
        "years": F.col("years"),
        "industry": F.col("industry"),
        "any_of": F.col("any_of"),
        "terms": F.col("terms"),
        "opening": opening,
        "categories": F.when(asks_category, _found(CATEGORIES, low, True)).otherwise(F.array().cast("array<string>")),
        "total": total,
        "roles": _found(ROLES, F.lower("line"), False),
        "speaks": F.col("line").rlike(ROLE_CONTEXT),
        **more,
    }
    rows = facts.select("posting_id", F.when(F.col("solid"), F.struct(*[c.alias(k) for k, c in line.items()])).alias("x")).groupBy("posting_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    rows = rows.withColumn("lines", F.filter("all", lambda x: x["bucket"] != "context"))
    title = F.try_element_at(F.slice(F.array_sort(F.transform("all", lambda x: x["line_no"])), 1, 2), F.lit(-1))
    rows = rows.withColumn("title", title)

    # a term begins on its first line that its guard accepts; a later line (or that one) may give its years
    techs = F.array_distinct(F.flatten(F.transform("lines", lambda x: x["opening"])))
    rows = rows.withColumn("reqs", F.transform(techs, lambda t: F.struct(t.alias("tech"), _first(F.col("lines"), lambda x: F.array_contains(x["opening"], t)).alias("own"))))
    filled = lambda r: _first(F.col("lines"), lambda x: (x["place"] >= r["own"]["place"]) & x["years"].isNotNull() & F.array_contains(x["terms"], r["tech"]))
    rows = rows.withColumn("reqs", F.transform("reqs", lambda r: F.struct(r["tech"], r["own"], filled(r).alias("filled"))))
    req = lambda r: F.struct(
        r["tech"].alias("tech"),
        F.element_at(_literal_map(DOMAIN_OF), r["tech"]).alias("domain"),
        (r["own"]["bucket"] == "required").alias("required"),
        r["own"]["place"].alias("place"),
        r["filled"]["years"].alias("years"),
        (r["own"]["industry"] | F.coalesce(r["filled"]["industry"], F.lit(False))).alias("industry"),
        r["own"]["any_of"].alias("any_of"),
        F.array_position(r["own"]["opening"], r["tech"]).cast("int").alias("rank"),
        r["filled"]["place"].alias("since"),
        r["own"]["industry"].alias("own_industry"),
    )
    return rows.withColumn("reqs", F.transform("reqs", req))


def with_entries(rows: DataFrame) -> DataFrame:
    """``rows`` (as from ``read``, with also: places of lines that are used besides) plus blank, weight and groups."""
    shared = lambda r: r["any_of"] & (F.size(F.filter("reqs", lambda q: q["place"] == r["place"])) >= 2)
    rows = rows.withColumn("reqs", F.transform("reqs", lambda r: F.struct(*[r[f] for f in ("tech", "domain", "required", "place", "years", "industry", "rank")], F.when(shared(r), r["place"]).alias("grp"))))

    # categories that no term of the same line and domain carries
    carried_there = lambda x, d: F.exists("reqs", lambda r: (r["place"] == x["place"]) & (F.coalesce(r["domain"], F.lit("")) == d))
    asked = lambda x: F.transform(F.filter(x["categories"], lambda d: ~carried_there(x, d)), lambda d: F.struct(d.alias("domain"), x["place"].alias("place"), (x["bucket"] == "required").alias("required"), x["years"].alias("years")))
    rows = rows.withColumn("asks", F.flatten(F.transform("lines", asked)))
    category = lambda d: F.struct(
        d.alias("domain"), _first(F.col("asks"), lambda a: a["domain"] == d)["required"].alias("required"), _first(F.col("asks"), lambda a: (a["domain"] == d) & a["years"].isNotNull())["years"].alias("years")
    )
    rows = rows.withColumn("categories", F.transform(F.array_distinct(F.transform("asks", lambda a: a["domain"])), category))

    # total years from a line that no term or category has used
    used = lambda x: F.exists("reqs", lambda r: (x["place"] >= r["place"]) & F.array_contains(x["terms"], r["tech"])) | F.exists("asks", lambda a: a["place"] == x["place"]) | F.array_contains("also", x["place"])
    roles = F.array_distinct(F.flatten(F.transform("all", lambda x: F.when((x["line_no"] <= F.col("title")) | ((x["bucket"] == "required") & x["speaks"]), x["roles"]).otherwise(F.array().cast("array<string>")))))
    carried = F.array_distinct(F.filter(F.transform(F.filter("reqs", lambda r: r["required"]), lambda r: r["domain"]), lambda d: d.isNotNull()))
    rows = rows.withColumns({"total": _first(F.col("lines"), lambda x: x["total"].isNotNull() & ~used(x))["total"], "roles": roles, "carried": carried})
    rows = rows.withColumns({"blank": F.size("all") == 0, "groups": _groups()})
    return rows.withColumn("weight", F.aggregate("groups", F.lit(0.0), lambda a, g: a + g["w"]))


def _groups() -> Column:
    """The entries of ``parsed`` from its columns reqs, categories, carried, roles and total."""
    asks = lambda x: F.coalesce(x["years"], F.lit(0.0)) > 0
    share = lambda x: F.when(x["required"], 1.0).otherwise(ADVANTAGE_SHARE)
    none = F.lit(None)

    def member(kind: str, tech: Column = none, domain: Column = none, required: Column = F.lit(True), years: Column = none, industry: Column = F.lit(False)) -> Column:  # noqa: B008
        return F.struct(F.lit(kind).alias("kind"), tech.cast("string").alias("tech"), domain.cast("string").alias("domain"), required.alias("required"), years.cast("double").alias("years"), industry.alias("industry"))

    entry = lambda w, members: F.struct(w.alias("w"), members.alias("members"))
    term = lambda r: member("term", r["tech"], r["domain"], r["required"], r["years"], r["industry"])
    grouped = lambda r: r["required"] & r["grp"].isNotNull()
    singles = F.transform(F.filter("reqs", lambda r: ~grouped(r)), lambda r: entry(F.when(asks(r), POINTS_WITH_YEARS).otherwise(POINTS_WITHOUT) * share(r), F.array(term(r))))
    of_group = lambda g: F.filter("reqs", lambda r: grouped(r) & (r["grp"] == g))
    either = F.transform(F.array_distinct(F.transform(F.filter("reqs", grouped), lambda r: r["grp"])), lambda g: entry(F.when(F.exists(of_group(g), asks), POINTS_WITH_YEARS).otherwise(POINTS_WITHOUT), F.transform(of_group(g), term)))
    cats = F.transform(F.filter("categories", lambda c: asks(c) | ~F.array_contains("carried", c["domain"])), lambda c: entry(F.when(asks(c), POINTS_WITH_YEARS).otherwise(POINTS_CATEGORY) * share(c), F.array(member("category", domain=c["domain"], required=c["required"], years=c["years"]))))
    taken = F.concat("carried", F.transform("categories", lambda c: c["domain"]))
    roles = F.transform(F.array_except("roles", taken), lambda d: entry(F.lit(POINTS_ROLE), F.array(member("role", domain=d))))
    total = F.when(F.col("total") > 0, F.array(entry(F.lit(POINTS_TOTAL), F.array(member("total", years=F.col("total")))))).otherwise(F.slice(F.array(entry(F.lit(0.0), F.array(member("none")))), 1, 0))
    return F.concat(singles, either, cats, roles, total)


def profiles(entries: DataFrame, summary: DataFrame) -> DataFrame:
    """profile_id, skills (tech -> effective and industry years), domains (domain -> years), total, from entries
    (profile_id, domain, tech, industry, personal, weight, tags) and summary (profile_id, total_years and, if given,
    domain_years: years of a domain that go before those of its entries).

    A term resolves to the entry of that name, else to the entry with the most effective years that has it as a tag."""
    default = F.coalesce(*[F.when(F.col("domain") == d, w) for d, w in PERSONAL_WEIGHT_BY_DOMAIN.items()], F.lit(PERSONAL_WEIGHT))
    weight = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("weight", default)))
    e = entries.withColumn("eff", F.coalesce("industry", F.lit(0.0)) + F.coalesce("personal", F.lit(0.0)) * (weight / 100))
    named = e.select("profile_id", F.lower("tech").alias("term"), F.lit(1).alias("own"), "eff", F.coalesce("industry", F.lit(0.0)).alias("ind"))
    tagged = e.select("profile_id", F.explode("tags").alias("tag"), "eff", "industry").select("profile_id", F.lower("tag").alias("term"), F.lit(0).alias("own"), "eff", F.coalesce("industry", F.lit(0.0)).alias("ind"))
    best = named.union(tagged).groupBy("profile_id", "term").agg(F.max(F.struct("own", "eff", "ind")).alias("b"))
    skills = best.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("b.eff", "b.ind")))).alias("skills"))
    domains = e.groupBy("profile_id", "domain").agg(F.max("eff").alias("eff")).groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("domain", "eff"))).alias("domains"))
    around = F.coalesce("domains", F.create_map().cast("map<string,double>"))
    if "domain_years" in summary.columns:
        around = F.map_zip_with(around, F.coalesce("domain_years", F.create_map().cast("map<string,double>")), lambda _, most, told: F.coalesce(told, most))
    return summary.join(skills, "profile_id", "left").join(domains, "profile_id", "left").select(
        "profile_id",
        F.coalesce("total_years", F.lit(0.0)).alias("total"),
        F.coalesce("skills", F.create_map().cast("map<string,struct<eff:double,ind:double>>")).alias("skills"),
        around.alias("domains"),
    )


def _curve(r: Column) -> Column:
    return F.when(r >= 1, 1.0).when(r <= 0, 0.0).otherwise(1 - F.pow(1 - r, F.lit(CURVE)))


def _ratio(m: Column) -> Column:
    """held and ratio of a member: whether the profile has the term at all (in industry, where that is asked for), and which share
    of its points it earns."""
    asks = F.coalesce(m["years"], F.lit(0.0)) > 0
    need = F.when(asks, m["years"]).otherwise(1.0)
    skill = F.try_element_at(F.col("skills"), m["tech"])
    eff, ind = F.coalesce(skill["eff"], F.lit(0.0)), F.coalesce(skill["ind"], F.lit(0.0))
    around = F.coalesce(F.try_element_at(F.col("domains"), m["domain"]), F.lit(0.0))
    second = F.coalesce(F.try_element_at(F.col("domains"), F.try_element_at(_literal_map(SECOND_DOMAIN), m["tech"])), F.lit(0.0))
    only = m["required"] & m["industry"]
    has = F.when(only, ind).otherwise(eff) > 0
    curve = _curve(F.least(F.lit(1.0), F.when(only, ind).otherwise(eff) / need))
    held = F.when(m["required"] & ~asks & ~m["industry"] & (eff >= PRESENCE_FROM), F.greatest(F.lit(PRESENCE), curve)).when(~m["required"] & ~asks, 1.0).otherwise(curve)
    of_term = F.when(has, held).otherwise(CONSOLATION * F.least(F.lit(1.0), F.greatest(around, second) / need))
    ratio = (
        F.when(m["kind"] == "term", of_term)
        .when(m["kind"] == "category", _curve(F.least(F.lit(1.0), around / need)))
        .when(m["kind"] == "role", F.when(around > 0, 1.0).otherwise(0.0))
        .when(m["kind"] == "total", F.when(F.col("total") > 0, _curve(F.col("total") / m["years"])).otherwise(CONSOLATION))
        .otherwise(0.0)
    )
    return F.struct(has.alias("held"), ratio.alias("ratio"), m["tech"].alias("tech"), m["kind"].alias("kind"), m["domain"].alias("domain"), m["required"].alias("required"), asks.alias("asks"), (around > 0).alias("around"))


def scores(items: DataFrame, people: DataFrame) -> DataFrame:
    """profile_id, posting_id, score, matched and missing terms for every pair. ``items`` as from ``parsed``, ``people`` as
    from ``profiles``; a blank posting has the least score. Profiles are the small side of this product: Spark broadcasts them while their size allows it."""
    return rated(items.crossJoin(people))


def rated(pairs: DataFrame, *more: str) -> DataFrame:
    """``scores`` of pairs that carry the columns of both sides; ``more`` names columns of the result, made from told: the
    entries with their members' ratios. If the pairs have extra_earned and extra_weight, these points are added."""
    extra = (F.col("extra_earned"), F.col("extra_weight")) if "extra_weight" in pairs.columns else (F.lit(0.0), F.lit(0.0))
    told = F.transform("groups", lambda g: F.struct(g["w"].alias("w"), F.transform(g["members"], _ratio).alias("members")))
    pairs = pairs.withColumns({"weight": F.col("weight") + extra[1], "extra": extra[0], "told": told}).select("profile_id", "posting_id", "blank", "weight", "extra", "told", *more)
    earned = F.aggregate("told", F.lit(0.0), lambda a, g: a + g["w"] * F.array_max(F.transform(g["members"], lambda m: F.struct(m["held"], m["ratio"])))["ratio"])
    terms = F.filter(F.flatten(F.transform("told", lambda g: g["members"])), lambda m: m["tech"].isNotNull())
    pairs = pairs.select("profile_id", "posting_id", "blank", "weight", (earned + F.col("extra")).alias("earned"), terms.alias("terms"), "told", *more)
    bare = F.size("terms") == 0
    share = F.when(F.col("weight") > 0, F.col("earned") / F.col("weight")).when(bare, 0.25).otherwise(0.5)
    raw = F.round(F.round(share, 9) * 100)
    raw = F.when(bare, F.least(raw, F.lit(float(NO_SIGNAL)))).otherwise(raw)
    score = F.when(F.col("blank"), LEAST).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), raw.cast("int")))).cast("long")
    names = lambda keep: F.sort_array(F.transform(F.filter("terms", keep), lambda x: x["tech"]))
    return pairs.select("profile_id", "posting_id", score.alias("score"), names(lambda x: x["ratio"] >= 0.5).alias("matched"), names(lambda x: x["ratio"] < 0.5).alias("missing"), *(["told", *more] if more else []))


def _keyed(postings: DataFrame) -> DataFrame:
    """posting_id, key (a digest of the text; null counts as empty), text."""
    text = F.coalesce("text", F.lit(""))
    return postings.select("posting_id", F.sha2(text, 256).alias("key"), text.alias("text"))


def _once(keyed: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    texts = keyed.groupBy("key", "text").agg(F.lit(1).alias("one")).select(F.col("key").alias("posting_id"), "text")
    made = f(texts)
    # postings are many however few bytes their files have: none of the sides may be broadcast on an estimate
    met = keyed.select("posting_id", "key").hint("merge").join(made.withColumnRenamed("posting_id", "key"), "key")
    return met.select(*made.columns)


def once_a_text(postings: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` of ``postings`` (posting_id, text), where ``f`` sees each distinct text once, under a digest as posting_id; all
    postings of that text get its rows. For ``f`` whose rows tell nothing of a posting but its id and what its text says."""
    return _once(_keyed(postings), f)


def top_postings(postings: DataFrame, people: DataFrame, k: int, least: int = 0) -> DataFrame:
    """``ranked`` of the ``scores`` of all ``postings``. Of postings with the same text only the ``k`` first meet the profiles:
    the others score the same and stand behind them in every list."""
    w = Window.partitionBy("key").orderBy("posting_id")
    few = _keyed(postings).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")
    return ranked(_once(few, lambda texts: scores(parsed(texts), people)), k, least)


def ranked(scored: DataFrame, k: int, least: int = 0) -> DataFrame:
    """The ``k`` best postings of each profile with a score of ``least`` or more, ties by posting."""
    w = Window.partitionBy("profile_id").orderBy(F.desc("score"), "posting_id")
    return scored.where(F.col("score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
