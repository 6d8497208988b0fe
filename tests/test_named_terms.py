"""Profile terms, unknown terms, tools and bullets against a plain reading of the rules, line by line."""

import random
import re

from matchweave.operators import matcher, named_terms

ENTRIES = "profile_id long, seq int, domain string, tech string, industry double, personal double, weight int, tags array<string>"
TOOLS = "profile_id long, tool string, found boolean, tags array<string>"


def says(low, term):
    t = term.lower()
    if re.search("[֐-׿]", t) or not re.search("[a-z0-9]", t):
        return t in low
    left = r"(?<![a-z0-9.])" if re.match("[a-z0-9]", t) else ""
    right = "" if not re.search("[a-z0-9]$", t) else r"(?![a-z0-9])" if t.endswith("s") else r"s?(?![a-z0-9])"
    return re.search(left + re.escape(t) + right, low) is not None


def years_of(entry):
    ind, per, w = entry["industry"] or 0, entry["personal"] or 0, entry["weight"]
    w = (75 if entry["domain"] == "ai_ml_llm" else 50) if w is None else w
    return ind + per * max(0, min(100, w)) / 100, ind


class Reader:
    """Reads one posting for one profile."""

    def __init__(self, profile):
        self.profile, self.seen, self.cats, self.used = profile, {}, {}, set()

    def read(self, lines):
        reqs, cats = [], []
        for no, line in lines:
            low = line.lower()
            m = re.search(r"(\d+(?:\.\d+)?)\s*(?:[-–—]|עד|to)\s*(\d+(?:\.\d+)?)\s*\+?\s*" + matcher.UNIT, low) or re.search(matcher.YEARS, low)
            years, industry = float(m[1]) if m else None, re.search(matcher.INDUSTRY_ONLY, line) is not None
            here, claimed = [], set()

            def fill(key, years=years, industry=industry, no=no):
                req = self.seen[key]
                if years is not None and req["years"] is None:
                    req["years"], req["industry"] = years, req["industry"] or industry
                self.used.add(no)

            def add(key, term, domain, years=years, industry=industry, no=no, here=here, claimed=claimed):
                req = {"tech": key.removeprefix("unk:"), "years": years, "domain": domain, "industry": industry, "group": None, "line": no}
                self.seen[key] = req
                claimed.add(term)
                here.append(req)

            for tech, domain in matcher.DOMAIN_OF.items():
                if not says(low, tech):
                    continue
                if tech in self.seen:
                    fill(tech)
                elif tech not in matcher.GUARDS or re.search(matcher.GUARDS[tech], low):
                    add(tech, tech, domain)
            for by_name in (True, False):
                for e in self.profile["entries"]:
                    key, tags = e["tech"].lower(), [t.lower() for t in e["tags"] or []]
                    specific = [t for t in tags if t not in named_terms.GENERIC]
                    found = [t for t in [key, *specific] if says(low, t)]
                    if key in self.seen:
                        if by_name and found:
                            fill(key)
                        continue
                    if not by_name and any(t in self.seen for t in specific):
                        continue
                    if any(w in self.seen for w in re.split(r"[\s.\-/]+", key)):
                        continue
                    options = [t for t in found if t not in claimed and (t == key or not by_name)]
                    if options:
                        add(key, options[0], e["domain"])
            if not here and (re.search("[֐-׿]", line) or re.search(named_terms.REQUEST, line)):
                for t in re.findall(rf"(?a:\b)({named_terms.CAPITALISED})(?a:\b)", line):
                    t = t.lower()
                    one = t[:-1] if len(t) > 3 and t.endswith("s") else t
                    if len(t) < 2 or t in named_terms.UNKNOWN_STOP or {t, one} & (self.seen.keys() | set(named_terms.GENERIC)) or "unk:" + t in self.seen:
                        continue
                    add("unk:" + t, t, None)
            if years is not None or re.search(matcher.CATEGORY_CONTEXT, line):
                for domain, words in matcher.CATEGORIES.items():
                    if any(says(low, w) if domain != "fullstack" else w in low for w in words) and not any(r["domain"] == domain for r in here):
                        if domain not in self.cats:
                            self.cats[domain] = {"domain": domain, "years": years}
                            cats.append(self.cats[domain])
                        elif self.cats[domain]["years"] is None:
                            self.cats[domain]["years"] = years
                        self.used.add(no)
            if here:
                self.used.add(no)
            if len(here) >= 2 and re.search(matcher.ANY_OF, low):
                for r in here:
                    r["group"] = no
            reqs += here
        return reqs, cats


def score(text, buckets, profile):
    if not text or not text.strip():
        return 18
    reader = Reader(profile)
    lines = [(no, line, b) for no, (line, b) in enumerate(buckets) if line.strip()]
    required, advantage = ([(no, x) for no, x, b in lines if b == kind] for kind in ("required", "advantage"))
    reqs, cats = reader.read(required)
    total_years = None
    used = set(reader.used)
    more, more_cats = reader.read(advantage)
    for part, taken in ((required, used), (advantage, reader.used)):
        for no, line in part:
            if no not in taken and total_years is None:
                total_years = next((float(m[1]) for p in matcher.TOTAL_YEARS if (m := re.search(p, line.lower()))), None)
    entries = profile["entries"]

    def years(tech):
        named = [years_of(e) for e in entries if e["tech"].lower() == tech]
        return max(named or [years_of(e) for e in entries if tech in [t.lower() for t in e["tags"] or []]], default=(0, 0))

    def around(domain):
        return profile["domains"].get(domain, max([years_of(e)[0] for e in entries if e["domain"] == domain], default=0))

    curve = lambda r: 1 if r >= 1 else 0 if r <= 0 else 1 - (1 - r) ** 1.5
    near = lambda r: 0.35 * min(1, max(around(r["domain"]), around(matcher.SECOND_DOMAIN.get(r["tech"]))) / (r["years"] or 1))

    def rate(r):
        eff, ind = years(r["tech"])
        eff = ind if r["industry"] else eff
        ratio = curve(min(1, eff / (r["years"] or 1)))
        return eff, max(ratio, 0.7) if not r["years"] and not r["industry"] and eff >= 0.5 else ratio

    earned = weight = 0.0
    groups = {}
    for r in reqs:
        groups.setdefault(r["group"] if r["group"] is not None else r["tech"], []).append(r)
    for members in groups.values():
        w = 10 if any(r["years"] for r in members) else 12
        weight += w
        eff, best = max((rate(r)[::-1] for r in members))[::-1]
        earned += w * (best if eff > 0 else max(map(near, members)))
    for r in more:
        w = (10 if r["years"] else 12) * 0.4
        weight += w
        eff = years(r["tech"])[0]
        earned += w * (near(r) if eff <= 0 else curve(min(1, eff / r["years"])) if r["years"] else 1)
    for c, mult in [(c, 1) for c in cats] + [(c, 0.4) for c in more_cats]:
        if c["years"] or not any(r["domain"] == c["domain"] for r in reqs):
            w = (10 if c["years"] else 8) * mult
            weight += w
            earned += w * curve(min(1, around(c["domain"]) / (c["years"] or 1)))
    for domain, words in matcher.ROLES.items():
        solid = [line for _, line, _ in lines]
        hit = any(w in x.lower() for x in solid[:2] for w in words) or any(w in x.lower() and re.search(matcher.ROLE_CONTEXT, x) for _, x in required for w in words)
        if hit and domain not in reader.cats and not any(r["domain"] == domain for r in reqs):
            weight += 8
            earned += 8 * (around(domain) > 0)
    if total_years:
        weight += 15
        earned += 15 * (curve(profile["total"] / total_years) if profile["total"] else 0.35)
    for kw in named_terms.TOOLS:
        if not says(text.lower(), kw) or any(kw == k or kw in re.split(r"[\s.\-/]+", k) for k in reader.seen):
            continue
        tool = next((profile["tools"][k] for k in (kw, kw.replace("/", "")) if k in profile["tools"]), None)
        hit = tool is not None and (tool[0] or any(says(text.lower(), t) for t in tool[1] or []))
        hit = hit or any(kw in [e["tech"].lower(), *re.split(r"[\s.\-/]+", e["tech"].lower()), *[t.lower() for t in e["tags"] or []]] for e in entries)
        earned, weight = earned + 4 * hit, weight + 4 * (hit or bool(profile["tools"]))
    bare = not reqs and not more
    raw = int(round(earned / weight if weight else 0.25 if bare else 0.5, 9) * 100 + 0.5)
    return max(18, min(94, min(raw, 40) if bare else raw))


PRODUCTS = ["DataPower", "IBM API Connect", "RabbitMQ", "SQL Server", "Go", "Express", "Kong Gateway", "C++", "Agile", "Git", "vector search", "LLM", "Java", "ברוקר"]
PIECES = [
    "- Experience with {a} or {b}", "ניסיון ב-{a} חובה", "- {n}+ years of {a}", "- {n} years of hands-on industry experience with {a}", "- {n} years of {a} experience", "{a} skills - advantage", "Nice to have:", "Requirements:",
    "Familiarity with {a} and {b}, git and agile", "- backend experience, {n} years", "- 5 years of experience", "About us:", "we like {a}", "one of the following: {a}, {b}", "Knowledge of Temporal Clouds, {b}", "ידע ב-DataPower ו-Kafka Streams", "go developer", "- {a}s and {b}",
]


def generated(seed, n_postings, n_profiles):
    draw = random.Random(seed)
    names = [*PRODUCTS, "python", "kafka", "docker", "redis", "react"]
    postings = [(i, "\n".join(["Backend Engineer", *(draw.choice(PIECES).format(a=draw.choice(names), b=draw.choice(names), n=draw.randint(1, 6)) for _ in range(draw.randint(1, 9)))])) for i in range(n_postings)]
    profiles = {}
    for p in range(n_profiles):
        known = draw.sample(names, draw.randint(0, 6))
        entries = [
            {"profile_id": p, "seq": k, "domain": draw.choice(["backend", "data_bi", "ai_ml_llm", "devops_cloud"]), "tech": t, "industry": draw.choice([None, 0.0, 0.5, 2.0]), "personal": draw.choice([None, 1.0, 3.0]), "weight": draw.choice([None, 0, 80, 150]), "tags": draw.choice([None, [], draw.sample([*names, "api", "jira", "MQ"], 3)])}
            for k, t in enumerate(known)
        ]
        tools = draw.choice([{}, {"git": (True, None), "cicd": (False, [])}, {"agile": (False, ["RabbitMQ"]), "jira": (None, ["scrum"])}])
        profiles[p] = {"entries": entries, "domains": draw.choice([{}, {"backend": 1.5}]), "total": draw.choice([0.0, 4.0]), "tools": tools}
    return postings, profiles


def tables(spark, postings, profiles):
    entries = spark.createDataFrame([tuple(e.values()) for p in profiles.values() for e in p["entries"]], ENTRIES)
    summary = spark.createDataFrame([(i, p["total"], p["domains"]) for i, p in profiles.items()], "profile_id long, total_years double, domain_years map<string,double>")
    tools = spark.createDataFrame([(i, t, *v) for i, p in profiles.items() for t, v in p["tools"].items()], TOOLS)
    return spark.createDataFrame(postings, "posting_id long, text string"), entries, summary, tools


def test_scores_follow_the_rules(spark):
    postings, profiles = generated(7, 60, 8)
    postings += [(100, None), (101, ""), (102, "DataPower\nDataPower"), (103, "- Experience with Temporal or DataPower")]
    frames = tables(spark, postings, profiles)
    buckets = {}
    for r in matcher.section_lines(frames[0].where("text IS NOT NULL")).orderBy("posting_id", "line_no").collect():
        buckets.setdefault(r.posting_id, []).append((r.line, r.bucket))
    got = {(r.posting_id, r.profile_id): r for r in named_terms.scores(*frames).collect()}
    assert len(got) == len(postings) * len(profiles)
    wrong = [(i, p, got[i, p].score, want) for i, text in postings for p, profile in profiles.items() if got[i, p].score != (want := score(text, buckets.get(i), profile))]
    assert not wrong, wrong[:5]
    terms = {t for r in got.values() for t in [*r.matched, *r.missing]}
    assert {"datapower", "ibm api connect", "rabbitmq", "temporal"} <= terms
    assert all(len(r.bullets) <= 4 for r in got.values()) and any(len(r.bullets) == 4 for r in got.values())


def test_bullets(spark):
    entries = [(1, 0, "backend", "DataPower", 4.0, None, None, ["gateway"]), (1, 1, "backend", "RabbitMQ", 0.25, None, None, None)]
    text = "Requirements:\n- 2 years of DataPower\n- Experience with RabbitMQ\n- Experience with Temporal\n- git"
    frames = (spark.createDataFrame([(1, text)], "posting_id long, text string"), spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([(1, 4.0)], "profile_id long, total_years double"), spark.createDataFrame([(1, "git", True, None)], TOOLS))
    row = named_terms.scores(*frames).collect()[0]
    assert row.bullets == ["ok:datapower:100", "part:rabbitmq:35", "ok:git", "miss:temporal"] and row.matched == ["datapower"] and row.missing == ["rabbitmq", "temporal"]


def test_nested_profiles(spark):
    e = "struct<industry_years:double,personal_years:double,personal_weight:int,search_tags:array<string>>"
    df = spark.createDataFrame([(1, {"backend": {"Java": (2.0, None, 50, ["jvm"]), "Go": (None, None, None, None)}}), (2, None), (3, {"mobile": None})], f"profile_id long, experience map<string,map<string,{e}>>")
    rows = sorted(tuple(r) for r in named_terms.flattened(df).collect())
    assert [(r[0], r[2], r[3], r[7]) for r in rows] == [(1, "backend", "Go", []), (1, "backend", "Java", ["jvm"])] or [(r[0], r[2], r[3], r[7]) for r in rows] == [(1, "backend", "Java", ["jvm"]), (1, "backend", "Go", [])]
    assert sorted(r[1] for r in rows) == [1, 2]


def test_empty_tables(spark):
    frames = [x.where("false") for x in tables(spark, [(1, "x")], {1: {"entries": [], "domains": {}, "total": 1.0, "tools": {}}})]
    assert named_terms.scores(*frames).count() == 0


def test_terms_without_latin_or_hebrew_letters(spark):
    """Cyrillic, Han and signs count anywhere in a line, with or without Hebrew beside them."""
    lines = [(0, "опыт с базами данных"), (1, "熟悉微服务架构"), (2, "ניסיון ב-微服务"), (3, "a ++ b\n😀"), (4, "nothing here"), (5, None), (6, "c++ and ברוקר")]
    terms = ["базами", "微服务", "++", "😀", "c++", "ברוקר", "", None]
    df = spark.createDataFrame(lines, "line_no int, low string")
    got = {(r.line_no, r.term) for r in named_terms.term_hits(df, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(n, t) for n, low in lines for t in terms if low and t and says(low, t)}
    assert {(0, "базами"), (1, "微服务"), (2, "微服务"), (3, "++"), (3, "😀"), (6, "++"), (6, "c++"), (6, "ברוקר")} == got


def test_scores_of_profiles_in_other_scripts(spark):
    entries = [(1, 0, "backend", "微服务", 4.0, None, None, None), (1, 1, "backend", "RabbitMQ", 1.0, None, None, ["очереди"])]
    text = "Requirements:\n- 微服务\n- очереди сообщений"
    frames = (spark.createDataFrame([(1, text)], "posting_id long, text string"), spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([(1, 4.0)], "profile_id long, total_years double"), spark.createDataFrame([(1, "git", True, None)], TOOLS))
    assert sorted(named_terms.scores(*frames).collect()[0].matched) == ["rabbitmq", "微服务"]
