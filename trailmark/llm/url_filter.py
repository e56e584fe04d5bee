"""URL filter: allow and block rules, then a classifier for all other URLs.

The classifier is a logistic regression on hashed character n-grams of host and
path, trained on a small labelled URL table that is made by rule from word lists
and looks like no table in particular. Host, path and rules are built-in
column expressions; the score is a map over Arrow batches. Nothing shuffles.

Edge cases: a null URL, or one without ``://``, has an empty host and an empty
path, fits no rule and gets the classifier's verdict on no n-grams, its bias.
Ports and user names stay part of the host. Repeated rows are judged each by
itself; an empty table gives no rows; other columns are ignored. With an empty
training table every score is 0.5, which allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shingles import mix

#: (verdict, host, path prefix). A rule fits its host and every subdomain.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words of URLs to block (1: gambling, drugs, adult, cracked software,
#: fakes, loans, lotteries, phishing, link spam, advertising and tracking) and of
#: ordinary ones (0), words that both use, last parts of hosts, first parts, languages.
WORDS = {
    1: (
        "casino slots poker roulette blackjack bet bets betting odds jackpot bonus win pills viagra cialis pharma meds steroids porn xxx adult cams sexy escort nude warez crack keygen torrent serial nulled replica fake outlet knockoff "
        "payday loan cash credit lottery prize claim winner giveaway reward phish verify suspended malware spyware hack spam farm seo backlinks linkfarm doorway cloak ads adserver adclick track tracker tracking banner popup pixel affiliate clicks promo leads"
    ).split(),
    0: (
        "library manual docs news wiki research calendar museum history health weather garden forum recipes maps project support journal theatre science books choir market radio parks transit village letters railway notes school college university hospital "
        "city council archive music gallery kitchen travel hotel bakery coffee cycling running football chess astronomy physics chemistry biology geology language grammar poetry novel film camera photo paint wood metal house energy water river forest mountain ocean"
    ).split(),
}
SHARED = "home page info about online free best new shop store blog site web my the go top world daily net hub center point link data service team group media".split()
ENDS = "com org net io info co eu de fr uk us biz site online app top".split()
FIRST = ("", "www.", "m.", "blog.", "shop.", "cdn.", "static.", "old.")
LANGUAGES = "en de fr es it pt nl pl sv cs".split()


def labelled_urls(n: int = 2400, words: dict[int, list[str]] = WORDS) -> list[tuple[int, str]]:
    """A labelled table of ``n`` URLs of many sites, one in four to block.

    Hosts and paths of both labels have the same shapes, last parts and shared
    words; a label's own words are in its hosts and in half of its paths. Half of
    the ordinary hosts are invented names. All choices follow a hash of the row.
    """

    def pick(some: Sequence[str], i: int, what: str) -> str:
        return some[crc32(f"{i}:{what}".encode()) % len(some)]

    def name(i: int, what: str) -> str:
        return "".join(pick("b c d f g h j k l m n p r s t v w z st tr th ch sh".split(), i, f"{what}{k}") + pick("a e i o u ea ou er an in".split(), i, f"{what}{k}v") for k in range(2 + crc32(f"{i}:{what}".encode()) % 2))

    out = []
    for i in range(n):
        label = int(i % 4 == 0)
        one, two, other, brand = pick(words[label], i, "one"), pick(words[label], i, "two"), pick(SHARED, i, "other"), name(i, "brand")
        if not label and i % 2:
            one = name(i, "one")
        shapes = (f"{one}.", f"{one}{two}.", f"{one}-{two}.", f"{other}-{one}.", f"{one}{other}.", f"{one}.{brand}.", f"{one}-{two}.{brand}.", f"{one}-{other}.{brand}.", f"{one}{i % 97}.")
        host = pick(FIRST, i, "first") + pick(shapes, i, "host") + pick(ENDS, i, "end")
        word, number = (two if crc32(f"{i}:own".encode()) % 2 else other), crc32(f"{i}:n".encode()) % 5000
        paths = ("", "/", f"/{word}", f"/{word}/{number}", f"/{word}-{other}.html", f"/{pick(LANGUAGES, i, 'l')}/{word}/{number}", f"/{pick(LANGUAGES, i, 'l')}/{number}", f"/{2005 + i % 20}/{1 + i % 12:02}/{word}-{other}/", "/index.php", f"/wiki/{word}", f"/~{word}/", f"/p/{number}", f"/category/{word}/page/{i % 9}")
        out.append((label, f"http{'s' * (i % 3 > 0)}://{host}{pick(paths, i, 'path')}"))
    return out


#: The training table.
LABELLED = tuple(labelled_urls())


def held_out(url: str) -> bool:
    """Of a third of the hosts; none of their URLs is trained on."""
    return crc32(parts_of(url)[0].encode()) % 3 == 1


def parts_of(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL."""
    rest = url.split("://", 1)[-1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Path: from there up to ``?``, ``#`` or the end. Else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text and as verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):  # the last `when` to be wrapped decides first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def hashed(parts: Sequence[str], kind: int, bits: int, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all character n-grams of ``^part$`` of all non-empty parts."""
    raws = [b"^" + p.encode("utf-8", "surrogatepass") + b"$" if p else b"" for p in parts]
    lengths = np.array([len(r) for r in raws], dtype=np.int64)
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    row, end = np.repeat(np.arange(len(parts)), lengths), np.repeat(np.cumsum(lengths), lengths)
    rows, buckets, at = [], [], np.arange(len(raw))
    for n in sizes:
        start = at[at + n <= end]
        h = np.full(len(start), n * 1000 + kind, dtype=np.uint64)
        for j in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + raw[start + j])
        rows.append(row[start])
        buckets.append((h & np.uint64((1 << bits) - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


class UrlModel:
    """Logistic regression over ``2 ** bits`` hashed n-gram buckets, full-batch descent."""

    def __init__(self, bits: int = 16, sizes: Sequence[int] = (3, 4, 5)):
        self.bits, self.sizes = bits, tuple(sizes)
        self.weights, self.bias, self.limit = np.zeros(1 << bits), 0.0, 0.5

    def counts(self, hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and count of every bucket of every URL, rows scaled to length 1."""
        found = [hashed(part, kind, self.bits, self.sizes) for kind, part in enumerate((hosts, paths))]
        keys, n = np.unique(np.concatenate([(r << self.bits) | b for r, b in found]), return_counts=True)
        row, bucket, n = keys >> self.bits, keys & ((1 << self.bits) - 1), n.astype(float)
        length = np.sqrt(np.bincount(row, n * n, minlength=len(hosts)))
        return row, bucket, n / length[row]

    def fit(self, rows: Sequence[tuple[int, str]], steps: int = 300, rate: float = 0.5, l2: float = 1e-5) -> UrlModel:
        """Full-batch descent with a step for each weight that shrinks with its past
        gradients; both labels weigh alike, however many rows they have."""
        if not rows:
            return self
        y = np.array([label for label, _ in rows], dtype=float)
        row, bucket, n = self.counts(*map(list, zip(*(parts_of(url) for _, url in rows), strict=True)))
        share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
        weigh = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        past, past_bias = np.full(1 << self.bits, 1e-12), 1e-12
        for _ in range(steps):
            z = np.bincount(row, self.weights[bucket] * n, minlength=len(y)) + self.bias
            error = (1 / (1 + np.exp(-z)) - y) * weigh
            slope = np.bincount(bucket, error[row] * n, minlength=1 << self.bits) + l2 * self.weights
            past += slope**2
            past_bias += error.sum() ** 2
            self.weights -= rate * slope / np.sqrt(past)
            self.bias -= rate * error.sum() / np.sqrt(past_bias)
        return self

    def settle(self, rows: Sequence[tuple[int, str]], wrong: float = 0.01) -> UrlModel:
        """The least limit from 0.5 on at which of the ordinary ``rows`` (of hosts not
        trained on) no more than a share of ``wrong`` is blocked."""
        plain = [parts_of(url) for label, url in rows if not label]
        if plain:
            scores = np.sort(self.score(*map(list, zip(*plain, strict=True))))
            self.limit = max(0.5, float(scores[-1 - int(wrong * len(scores))]))
        return self

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """The probabilities that the URLs are to be blocked."""
        row, bucket, n = self.counts(hosts, paths)
        return 1 / (1 + np.exp(-np.bincount(row, self.weights[bucket] * n, minlength=len(hosts)) - self.bias))


@lru_cache(maxsize=4)
def trained(labelled: tuple[tuple[int, str], ...] = LABELLED) -> UrlModel:
    return UrlModel().fit([r for r in labelled if not held_out(r[1])]).settle([r for r in labelled if held_out(r[1])])


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[int, str]] = LABELLED) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every URL.

    ``score`` is the classifier's probability of block, ``verdict`` the rule's or,
    without a rule, block where the score is above the model's limit. The model is
    trained on two thirds of the labelled hosts, the limit set on the others.
    """
    model = trained(tuple(labelled))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            # In runs of bounded bytes: a very long URL is a run of its own.
            ends = np.cumsum(hosts.str.len() + paths.str.len()).to_numpy() // 100_000
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(hosts)]
            runs = [model.score(hosts[a:b].tolist(), paths[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.Series(np.concatenate(runs) if len(hosts) else [], dtype="float64")

    host, path = host_and_path(F.col(url_col).cast("string"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "ruled": verdict, "score": score("host", "path")})
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > model.limit, "block").otherwise("allow")).alias("verdict"), "score")
    )
