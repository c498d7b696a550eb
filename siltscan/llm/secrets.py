"""Secret scans: corpus-wide ownership frequency of candidate credentials.

Candidates come from one pass of a regular expression over whole texts, spared where a cheap test rules any match out: credential assignments, quoted or not, self-describing
key formats and PEM private keys, each taken whole however long, kept where they have ``MIN_LENGTH`` characters, ``MIN_DISTINCT`` distinct ones, and a letter and a digit.
A candidate is hashed as soon as it is found; what is counted, joined and cut to the checkpoint folder are hashes only. The
corpus counts how many owners, repositories and documents hold a hash. One held by more than ``MAX_OWNERS`` owners or in
more than ``MAX_REPOS`` repositories is a widely copied example; any other is owner-specific and looks live. The owner is
a document's ``source``; a repository is a source's texts in one language.

Null and empty texts have no candidates; texts of any length are searched whole. Null owners count as one owner of their
own, null languages as one of their own. Repeated rows count once. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan.llm._common import BROADCAST_ROWS, cut, small

NAME = (
    "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|"
    "[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY|[Pp]rivate[_-]?[Kk]ey|[Cc]lient[_-]?[Ss]ecret|[A-Za-z0-9][_-](?:KEY|[Kk]ey)|[a-z]Key)"
)
VALUE = "[A-Za-z0-9_/+=.-]"
#: Unquoted, a value doesn't end in a full stop and is no call, index or object's member.
BARE = VALUE + "{15,}[A-Za-z0-9_/+=-](?![A-Za-z0-9_/+=(\\[-]|[.]+[A-Za-z0-9_/+=-])"
ASSIGNED = NAME + "[\"']?[ \\t]*[:=][ \\t]*(?:[\"']" + VALUE + "{16,}+[\"']|" + BARE + ")"
JWT = "eyJ[A-Za-z0-9_-]{10,}+[.]eyJ[A-Za-z0-9_-]{10,}+[.][A-Za-z0-9_-]{10,}+"
#: A JWT is looked for from the start of its run of characters, which is first seen to be followed by the next part: so a
#: run of many beginnings of JWTs is read once. What goes before it in the run is taken off by ``secret_of``.
FORMATS = (
    "AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|"
    "AIza[0-9A-Za-z_-]{35}|[rs]k_live_[0-9a-zA-Z]{24,}+|"
    "(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*+[.]eyJ[A-Za-z0-9_-]{10,}+[.][A-Za-z0-9_-]{10})[A-Za-z0-9_-]*?" + JWT
)
#: With headers, and with line breaks that are escaped.
PEM = (
    "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:\\s|\\\\[nrt])*+(?:[A-Za-z-]++: [^\\r\\n\\\\]*+(?:[\\r\\n]|\\\\[nr])++)*+"
    "[A-Za-z0-9+/=\\s\\\\]*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
)
PATTERN = f"{PEM}|{ASSIGNED}|{FORMATS}"
QUOTED = "[:=][ \\t]*[\"']?(" + VALUE + "{16,})[\"']?$"
MIN_LENGTH, MIN_DISTINCT, MAX_OWNERS, MAX_REPOS = 16, 8, 2, 3
REDACTED = "[SECRET]"


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def secret_of(match: Column) -> Column:
    """The secret of a match: a PEM key whole, an assignment's value, a JWT without what precedes it, or all of the match."""
    jwt = F.regexp_extract(match, JWT, 0)
    return F.when(match.startswith("-----"), match).when(match.rlike(QUOTED), F.regexp_extract(match, QUOTED, 1)).when(F.length(jwt) > 0, jwt).otherwise(match)


#: What any match must hold; far cheaper to look for than the pattern, whose alternatives start with common letters.
ASSIGNS = "[:=][ \\t]*[\"']?" + VALUE + "{16}"
PREFIXES = ("PRIVATE KEY", "AKIA", "ghp_", "gho_", "ghs_", "ghu_", "glpat-", "xox", "AIza", "k_live_", "eyJ")


def may_match(text: Column) -> Column:
    """False only for texts without a match."""
    out = text.rlike(ASSIGNS)
    for prefix in PREFIXES:
        out = out | F.contains(text, F.lit(prefix))
    return F.coalesce(out, F.lit(False))


def looks_random(secret: Column) -> Column:
    return (
        (F.length(secret) >= MIN_LENGTH)
        & (F.size(F.array_distinct(F.split(secret, ""))) >= MIN_DISTINCT)
        & secret.rlike("[A-Za-z]")
        & secret.rlike("[0-9]")
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, owner, repo, secret_sha256)."""
    match = docs.where(may_match(docs["text"])).select("doc_id", "source", "lang", F.explode(found(F.col("text"))).alias("m"))
    owner = F.coalesce("source", F.lit(""))
    return (
        match.select("doc_id", owner.alias("owner"), F.concat_ws("/", owner, F.coalesce("lang", F.lit(""))).alias("repo"), secret_of(F.col("m")).alias("s"))
        .where(looks_random(F.col("s")))
        .select("doc_id", "owner", "repo", F.sha2("s", 256).alias("secret_sha256"))
        .distinct()
    )


def ownership(found_: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per hash: how many owners, repositories and documents hold it, and whether it looks live."""
    return found_.groupBy("secret_sha256").agg(
        F.countDistinct("owner").alias("n_owners"),
        F.countDistinct("repo").alias("n_repos"),
        F.countDistinct("doc_id").alias("n_docs"),
    ).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def secret_scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``doc_id``, ``secret_sha256``, the three counts and ``verdict`` (live or example) of each candidate of each document.

    The texts are read once; only the candidates' hashes, cut to the checkpoint folder, are shuffled. The counts are
    broadcast where their checked size allows, so that a popular example is no hot key of the join back.
    """
    each = cut(candidates(docs))
    return each.join(small(ownership(each, max_owners, max_repos)), "secret_sha256").select(
        "doc_id", "secret_sha256", "n_owners", "n_repos", "n_docs", F.when(F.col("live"), "live").otherwise("example").alias("verdict")
    )


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``docs`` with every live-looking secret replaced by ``REDACTED`` and ``n_chars`` brought up to date.

    Every row stays. Where the table of live hashes by document is small, by its checked size, it is broadcast. Beyond
    that, rows that can't have a candidate pass straight through, and only the others are shuffled to meet it. Only texts
    of documents with live hashes are searched again, for the secrets themselves, which are never written anywhere.
    """
    each = cut(candidates(docs))
    live = each.join(ownership(each, max_owners, max_repos).where("live"), "secret_sha256", "left_semi")
    by_doc = cut(live.groupBy(F.col("doc_id").alias("__silt_id")).agg(F.collect_set("secret_sha256").alias("__silt_hashes")))
    if by_doc.count() <= BROADCAST_ROWS:
        return _redacted(docs, F.broadcast(by_doc), docs.columns)
    has = may_match(docs["text"])
    return docs.where(~has).unionByName(_redacted(docs.where(has), by_doc, docs.columns))


def _redacted(docs: DataFrame, by_doc: DataFrame, columns: list[str]) -> DataFrame:
    hashes = by_doc["__silt_hashes"]
    joined = docs.join(by_doc, docs["doc_id"].eqNullSafe(by_doc["__silt_id"]), "left")
    own = F.filter(F.array_distinct(F.transform(found(docs["text"]), secret_of)), lambda s: F.array_contains(hashes, F.sha2(s, 256)))
    # Longest first, so that a secret inside another doesn't break it.
    own = F.array_sort(own, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    text = F.when(hashes.isNull(), docs["text"]).otherwise(F.aggregate(own, docs["text"], lambda t, s: F.replace(t, s, F.lit(REDACTED))))
    n = F.when(hashes.isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None
    return joined.select(*[text.alias(c) if c == "text" else n.alias(c) if c == "n_chars" else docs[c] for c in columns])


def _greedy(pattern: str) -> str:
    """A pattern whose possessive quantifiers are greedy: where it matters what follows is in none of the repeated classes."""
    return pattern.replace("*+", "*").replace("++", "+").replace("}+", "}")


#: The same patterns for DuckDB, which has no looking ahead or back: an unquoted value takes in what must not follow it,
#: and a JWT's run needs no mark of its start, as the first match is the leftmost.
SQL_LAST = "[A-Za-z0-9_/+=-]"
SQL_BARE = VALUE + "{15,}" + SQL_LAST + "(?:[.]*$|[.]+[^A-Za-z0-9_/+=.-]|[^A-Za-z0-9_/+=.(\\[-])"
SQL_ASSIGNED = NAME + "[\"']?[ \\t]*[:=][ \\t]*(?:[\"']" + VALUE + "{16,}[\"']|" + SQL_BARE + ")"
SQL_PATTERN = f"{_greedy(PEM)}|{SQL_ASSIGNED}|{_greedy(FORMATS[: FORMATS.index('(?<')])}[A-Za-z0-9_-]*?{_greedy(JWT)}"
SQL_QUOTED = "[:=][ \\t]*[\"'](" + VALUE + "{16,})[\"']$"
SQL_UNQUOTED = "[:=][ \\t]*(" + VALUE + "{15,}" + SQL_LAST + ")(?:[.]*|[.]*[^A-Za-z0-9_/+=.-])$"
ORACLE = f"""
WITH match AS (
  SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '{SQL_PATTERN.replace("'", "''")}', 0)) AS m FROM documents
), each AS (
  SELECT DISTINCT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo,
    CASE WHEN starts_with(m, '-----') THEN m
      WHEN regexp_matches(m, '{SQL_QUOTED.replace("'", "''")}') THEN regexp_extract(m, '{SQL_QUOTED.replace("'", "''")}', 1)
      WHEN regexp_matches(m, '{SQL_UNQUOTED}') THEN regexp_extract(m, '{SQL_UNQUOTED}', 1)
      WHEN regexp_matches(m, '{_greedy(JWT)}') THEN regexp_extract(m, '{_greedy(JWT)}') ELSE m END AS secret
  FROM match
), kept AS (
  SELECT * FROM each WHERE length(secret) >= {MIN_LENGTH} AND len(list_distinct(string_split(secret, ''))) >= {MIN_DISTINCT}
    AND regexp_matches(secret, '[A-Za-z]') AND regexp_matches(secret, '[0-9]')
), own AS (
  SELECT secret, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos, count(DISTINCT doc_id) AS n_docs
  FROM kept GROUP BY secret
)
SELECT k.doc_id, sha256(secret) AS secret_sha256, n_owners, n_repos, n_docs,
  CASE WHEN n_owners <= {MAX_OWNERS} AND n_repos <= {MAX_REPOS} THEN 'live' ELSE 'example' END AS verdict
FROM (SELECT DISTINCT doc_id, owner, repo, secret FROM kept) k JOIN own USING (secret)
"""
