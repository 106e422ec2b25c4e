"""Quality rules (operator 5): a ledger of failure bits and measurements, and policies over it.

Every rule is evaluated once per document. The ledger holds one bit per failed rule and what was measured, so a
policy (a versioned mask of the bits that reject) and its ablations are bitwise aggregations over the ledger, without
another look at the texts. Policy v2, by which the query and the pipeline keep, has the rules of v1 and `abusive_words`:
whole words of a lexicon, weighed by severity against the length of the text.

Defined cases: a null text counts as empty; an empty text has no words and fails `few_words`; repeated rows give
repeated rows; an empty table gives an empty ledger; a null doc_id stays null; other columns are not read.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import bounded_batches, columns_of, documents, id_and_text

#: The rules by bit, in order.
RULES = ("few_words", "repeated_words", "symbols", "word_length", "duplicate_lines", "few_letters", "abuse")
#: Words of abuse; three or more that make up 1 % of a text fail `abuse`.
ABUSE = ("disgusting", "idiot", "scum", "trash", "worthless", "moron", "vermin", "pathetic", "stupid", "garbage")
#: The rules of v2, by bit.
RULES_V2 = (*RULES, "abusive_words")
#: Lower-case words of abuse in several languages by severity; those with a harmless use weigh 1. Words that
#: are everyday ones in another of the languages (con, retard, dom, hell), animals and waste are left out.
SEVERITY = {
    1: """
        trash garbage rubbish pathetic disgusting worthless stupid stupidity dumb clown clowns vermin filth filthy fool fools foolish weirdo crap crappy shameless coward cowards cowardly liar liars
        hypocrite jerk jerks idiotic moronic sucks ass prick pricks
        dreck dumme dummer dummes dummen blöd blöde blöder blöden doof doofe ekelhaft widerlich erbärmlich jämmerlich feigling lügner
        ordure ordures stupides dégoûtant dégoûtante minable minables pathétique menteur menteuse bouffon bouffons débile débiles
        estúpido estúpida estúpidos estúpidas asqueroso asquerosa asquerosos patético patética payaso payasa payasos tonto tonta tontos tontas cobarde cobardes mentiroso mentirosa perdedor perdedora zorra zorras capullo
        stupido stupida stupidi schifoso schifosa pagliaccio codardo bugiardo lixo nojento nojenta palhaço covarde walgelijk waardeloos lafaard leugenaar eikel
    """,
    2: """
        idiot idiots moron morons imbecile imbeciles scum scumbag scumbags loser losers dumbass dimwit dimwits halfwit nitwit numbskull numskull dunce blockhead airhead douchebag douchebags
        bastard bastards bitch bitches asshole assholes arsehole arseholes arse bullshit shit shitty shithead dickhead dickheads wanker wankers tosser twat twats slut sluts whore whores skank retarded
        lowlife lowlifes sleazebag dirtbag dirtbags cretin cretins dipshit jackass jackasses pervert perverts subhuman subhumans fuck fucks fucked fucking fucker fuckers
        idioten idiotin trottel vollidiot vollidioten deppen schwachkopf dummkopf dumpfbacke arschloch arschlöcher arsch scheiße scheiß scheißkerl abschaum wichser drecksau miststück mistkerl hurensohn hurensöhne
        schlampe schlampen spast vollpfosten missgeburt fotze verpiss untermensch untermenschen
        idiote idiotes imbécile imbéciles crétin crétine crétins abruti abrutie abrutis connard connards connarde connasse salaud salauds salope salopes salopard enculé enculés pute putes putain merde merdique
        bâtard bâtards raclure racaille couillon enfoiré enfoirés
        idiota idiotas imbécil imbéciles gilipollas cabrón cabrones pendejo pendeja pendejos puta putas puto putos mierda coño hijoputa bastardo bastardos escoria tarado tarada mamón culero
        imbecille imbecilli cretino cretina cretini stronzo stronza stronzi merda cazzo coglione coglioni puttana bastardi vaffanculo feccia
        otário otária babaca babacas caralho porra escroto cuzão idioot idioten sukkel klootzak klootzakken lul hoer kut trut mongool
    """,
    4: """
        motherfucker motherfuckers motherfucking cunt cunts faggot faggots fag fags kys cocksucker cocksuckers kinderficker nègre nègres pédé pédés bougnoule bougnoules sudaca sudacas maricón maricones
        kanake kanaken nigger niggers kike kikes wetback wetbacks tranny trannies frocio froci viado kankerhoer
    """,
}
#: The most severe list that names a word counts.
ABUSIVE = {w: n for n in sorted(SEVERITY) for w in SEVERITY[n].split()}
#: Abusive words that weigh ABUSIVE_LEAST or more together, and one for each ABUSIVE_WORDS words of the text, fail `abusive_words`.
ABUSIVE_LEAST, ABUSIVE_WORDS = 2, 100
_LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that count as symbols, and white space.
SYMBOLS, SPACE = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letter_words long, n_abuse long, abusive_weight long, fail_bits long"


@dataclass(frozen=True)
class Policy:
    """A version, and the rules that reject a document."""

    version: str
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES_V2.index(r) for r in self.rejects)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", RULES)
V2 = Policy("v2", RULES_V2)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n, first, at = len(words), {}, bytearray(len(words))
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(w, i)
        if j != i:
            at[j] = at[j + 1] = at[j + 2] = at[i] = at[i + 1] = at[i + 2] = 1
    return at.count(1) if n else 0


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the ledger's order."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    seen: set[str] = set()
    dup = full = 0
    for x in lines:
        if x.strip(SPACE):
            full += 1
            if x in seen:
                dup += 1
            else:
                seen.add(x)
    letters = sum(w[0] > 127 or w[:1].isalpha() for w in words)
    low = text.lower()
    abuse = sum(low.count(a) for a in ABUSE)
    weight = sum(map(ABUSIVE.get, filter(ABUSIVE.__contains__, _LETTERS.findall(low))))
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), full, letters, abuse, weight)


def failures(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int, n_letter_words: int, n_abuse: int, abusive_weight: int) -> int:
    """A bit for each failed rule; whole-number comparisons only."""
    failed = (
        n_words < 50,
        100 * n_repeat_words > 50 * n_words,
        10 * n_symbols > n_words,
        word_chars < 2 * n_words or word_chars > 15 * n_words,
        n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines,
        10 * n_letter_words < 6 * n_words,
        n_abuse >= 3 and 100 * n_abuse >= n_words,
        abusive_weight >= ABUSIVE_LEAST and ABUSIVE_WORDS * abusive_weight >= n_words,
    )
    return sum(1 << i for i, x in enumerate(failed) if x)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in columns_of(batches, "doc_id", "text"):
        found = [measure(t) for t in texts]
        cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 9
        bits = pa.array([failures(*x) for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols, bits], names=[x.split()[0] for x in LEDGER.split(", ")])


def ledger(docs: DataFrame) -> DataFrame:
    """A row per document: every measurement, and a bit per failed rule."""
    bounded_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_rows, LEDGER)


def rejected(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept` under a policy."""
    return book.withColumn("kept", ~rejected(policy))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would be kept without it; sums over the bits.

    book: fail_bits, and their number `n` if rows of equal bits are counted already.
    """
    n = F.col("n") if "n" in book.columns else F.lit(1)
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    of = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    sums = [f for r in policy.rejects for b in (1 << RULES_V2.index(r),) for f in (of(bits.bitwiseAND(F.lit(b)) != 0).alias(f"f_{r}"), of(bits == b).alias(f"o_{r}"))]
    one = book.agg(of(F.lit(True)).alias("all"), of(bits != 0).alias("rejected"), *sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only_this")) for r in policy.rejects])
    return one.select(F.lit(policy.version).alias("policy"), F.col("all").alias("n_docs"), F.col("rejected").alias("n_rejected"), F.inline(rows))


def _verdict(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    book = apply_policy(ledger(documents(spark, sf_dir)), policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("fail_bits")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rejected(BASE).alias("base_failed"), "kept", bits)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict(spark, sf_dir, V2)


def quality_rules_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger under the earlier policy."""
    return _verdict(spark, sf_dir, V1)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and rejects alone."""
    book = ledger(documents(spark, sf_dir)).select("fail_bits").groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    return ablations(book, V1).unionByName(ablations(book, V2))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The verdict is computed beside the row, so no join is needed, and rows without a doc_id are judged like any other.
    """
    bounded_batches(spark)
    verdict = F.pandas_udf(_verdicts, "long")
    return docs.filter(verdict(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(V2.mask)) == 0)


def _verdicts(texts: pd.Series) -> pd.Series:
    return pd.Series([failures(*measure(t)) for t in texts], dtype="int64")


ORACLE_V1 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS t FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letter_words,
        len(regexp_extract_all(lower(text), 'disgusting|idiot|scum|trash|worthless|moron|vermin|pathetic|stupid|garbage')) AS n_abuse
      FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT + 16 * (n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
        + 32 * (10 * n_letter_words < 6 * n_words)::BIGINT + 64 * (n_abuse >= 3 AND 100 * n_abuse >= n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

#: ORACLE_V1 with the bit of `abusive_words`.
ORACLE_OP5 = rf"""
WITH v1 AS ({ORACLE_V1}),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS ws FROM documents),
a AS (SELECT doc_id, {" + ".join(f"{n} * len(list_filter(ws, lambda x: x IN ({', '.join(repr(w) for w, k in ABUSIVE.items() if k == n)})))" for n in SEVERITY)} AS abusive_weight FROM t),
f AS (SELECT v1.* EXCLUDE (fail_bits, kept), fail_bits + 128 * (abusive_weight >= {ABUSIVE_LEAST} AND {ABUSIVE_WORDS} * abusive_weight >= n_words)::BIGINT AS fail_bits FROM v1 JOIN a USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

ORACLE_ABLATIONS = rf"""
WITH b AS (SELECT fail_bits FROM ({ORACLE_OP5})), p(policy, mask) AS (VALUES ('v1', {V1.mask}), ('v2', {V2.mask})),
r(rule, bit) AS (VALUES {", ".join(f"('{x}', {1 << i})" for i, x in enumerate(RULES_V2))})
SELECT policy, count(*) AS n_docs, count(*) FILTER (fail_bits & mask <> 0) AS n_rejected, rule,
       count(*) FILTER (fail_bits & mask & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only_this
FROM b, p, r WHERE mask & bit <> 0 GROUP BY policy, rule
"""
