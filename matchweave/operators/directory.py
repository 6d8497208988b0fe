"""Directory of contacts: upserts by e-mail, search, eligibility and referral states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions import text as T

#: Fixed list of webmail domains that are no company addresses.
WEBMAIL = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "hotmail.co.il", "live.com", "msn.com", "yahoo.com", "yahoo.co.il", "walla.co.il",
    "walla.com", "icloud.com", "me.com", "aol.com",
)
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
FLOOR_SCORE = 75


def _present(x: Column) -> Column:
    """The stripped value, null if blank."""
    s = T.stripped(x)
    return F.when(s != "", s)


def normalized(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"email": T.normalized_email(F.col("email")), "company": T.normalized_company(F.col("company")), "full_name": _present(F.col("full_name")), "phone": _present(F.col("phone"))})


def rejection(rows: DataFrame) -> Column:
    """Why a contribution is refused, null if it isn't; the first rule that fails counts."""
    email = rows["email"]
    return (
        F.when(email.isNull() | ~email.rlike(EMAIL), "bad_email")
        .when(F.substring_index(email, "@", -1).isin(*WEBMAIL), "webmail")
        .when(F.coalesce(rows["company"], F.lit("")) == "", "no_company")
    )


def upsert_outcomes(rows: DataFrame) -> DataFrame:
    """seq, email, outcome of each contribution in order: rejected, created, enriched (it fills a missing name or phone), unchanged.

    An e-mail's contributions form one window; what came before is summed up in it, so no list is gathered."""
    rows = normalized(rows)
    rows = rows.withColumn("reason", rejection(rows))
    good = rows.where("reason is null")
    before = Window.partitionBy("email").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = {c: F.max(c).over(before) for c in ("full_name", "phone")}
    first = F.count("*").over(before) == 0
    fills = F.lit(False)
    for c, k in known.items():
        fills = fills | (k.isNull() & F.col(c).isNotNull())
    done = good.select("seq", "email", F.when(first, "created").when(fills, "enriched").otherwise("unchanged").alias("outcome"))
    return done.unionByName(rows.where("reason is not null").select("seq", "email", F.lit("rejected").alias("outcome")))


def directory(rows: DataFrame) -> DataFrame:
    """email, company, full_name, phone, verified: first present value of each field; verified only ever rises."""
    rows = normalized(rows)
    rows = rows.where(rejection(rows).isNull())
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("email").agg(F.min_by("company", "seq").alias("company"), at("full_name"), at("phone"), F.max("verified").alias("verified"))


def roster(rows: DataFrame) -> DataFrame:
    """email, company, domains, threshold, opted_in from a sheet: the last row of an e-mail overwrites."""
    rows = normalized(rows)
    parsed = rows.where(rejection(rows).isNull()).select("seq", "email", "company", T.domain_list(F.col("domains")).alias("domains"), T.threshold(F.col("threshold")).alias("threshold"), T.ticked(F.col("opt_in")).alias("opted_in"))
    last = F.max_by(F.struct("company", "domains", "threshold", "opted_in"), "seq").alias("last")
    return parsed.groupBy("email").agg(last).select("email", "last.*")


def public(people: DataFrame) -> DataFrame:
    """What others may see: no e-mail, no phone."""
    return people.drop("email", "phone")


def search(people: DataFrame, company: str, k: int = 10) -> DataFrame:
    """The first ``k`` people (by e-mail) whose company is or begins with the given one; a blank one finds nobody."""
    wanted = T.normalized_company(F.lit(company))
    return people.where((wanted != "") & F.startswith(F.col("company"), wanted)).orderBy("email").limit(k)


def import_report(outcomes: DataFrame) -> DataFrame:
    """One row: created, enriched, unchanged, rejected."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "enriched", "unchanged", "rejected")])


def import_errors(rows: DataFrame) -> DataFrame:
    """seq, reason of each refused row of a sheet: the first rule that it fails."""
    rows = normalized(rows)
    return rows.select("seq", rejection(rows).alias("reason")).where("reason is not null")


def missing_columns(header: list[str | None], required: set[str]) -> list[str]:
    """The required columns that a sheet's header lacks, white space and letter case aside."""
    return sorted(required - {(name or "").strip().lower() for name in header})


def eligible(requests: DataFrame, employees: DataFrame, floor: int = FLOOR_SCORE) -> DataFrame:
    """request_id, employee_id, available for requests (request_id, company, score): the least id among the company's employees
    who opted in and whose threshold the score meets; never below the floor.

    The directory is reduced first: of employees with the same company and threshold only the least id can be chosen."""
    options = employees.where("opted_in").groupBy("company", "threshold").agg(F.min("employee_id").alias("employee_id"))
    met = requests.where(F.col("score") >= floor).join(options, "company").where(F.col("threshold") <= F.col("score"))
    best = met.groupBy("request_id").agg(F.min("employee_id").alias("employee_id"))
    return requests.join(best, "request_id", "left").select("request_id", "employee_id", F.col("employee_id").isNotNull().alias("available"))


def without_active(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Requests for whose user and job none is pending or accepted."""
    return requests.join(active.where(F.col("status").isin("pending", "accepted")).select("user_id", "job").distinct(), ["user_id", "job"], "left_anti")


def referral_states(requests: DataFrame, answers: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """request_id, status, refunded at ``now``: the first answer (accepted or declined) within the term decides; without one a
    request expires after ``days``. Declined and expired requests are refunded."""
    term = F.make_dt_interval(F.lit(days))
    timely = answers.join(requests.select("request_id", "created_at"), "request_id").where((F.col("ts") >= F.col("created_at")) & (F.col("ts") <= F.col("created_at") + term) & (F.col("ts") <= now))
    first = timely.groupBy("request_id").agg(F.min_by("answer", F.struct("ts", "answer_id")).alias("answer"))
    status = F.coalesce(F.col("answer"), F.when(F.col("created_at") + term < now, "expired").otherwise("pending"))
    return requests.join(first, "request_id", "left").select("request_id", status.alias("status"), status.isin("declined", "expired").alias("refunded"))
