"""URL filter by a weighted vocabulary, with allow and block rules for hosts and paths.

An Aho-Corasick automaton finds the terms of the vocabulary in the lower-cased URL in one pass. A term counts only if no ASCII letter or
digit stands next to it. One strict term rejects a URL, and so do several distinct soft terms.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_rows

STRICT_TERMS = ("casino", "cialis", "escorts", "hentai", "phishing", "porn", "porno", "sexcam", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "ads", "adult", "bet", "bets", "bonus", "cheap", "crack", "escort", "farm", "free", "jackpot", "keygen", "loan", "lottery", "nude",
    "payday", "pharmacy", "pill", "pills", "poker", "replica", "sex", "slots", "torrent", "track", "tracker", "win", "winner", "x",
)
COLUMNS = "host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>"
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class UrlRules:
    """``rules`` are (verdict, host and path): a rule holds for its host and all subdomains, for paths that start with its path; the
    longest one decides, and of equally long ones a blocking one."""

    rules: tuple[tuple[str, str], ...] = ()
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_limit: int = 2


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Judge:
    def __init__(self, rules: UrlRules) -> None:
        import ahocorasick

        self.limit = rules.soft_limit
        self.terms = ahocorasick.Automaton()
        for kind, terms in (("soft", rules.soft), ("strict", rules.strict)):
            for term in terms:
                self.terms.add_word(term.lower(), (kind, term.lower()))
        self.terms.make_automaton()
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules.rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(_lower(host), []).append(("/" + path, rule, verdict))

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple = (-1, "", None, None)
        at = 0
        while True:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    best = max(best, (len(rule), verdict, rule, verdict))  # "block" sorts after "allow"
            at = host.find(".", at) + 1
            if not at:
                return best[2], best[3]

    def found(self, url: str) -> dict[str, list[str]]:
        """Distinct terms by kind, in order."""
        hits: dict[str, set] = {"strict": set(), "soft": set()}
        for end, (kind, term) in self.terms.iter(url):
            start = end - len(term) + 1
            if not (start and _alnum(url[start - 1])) and not (end + 1 < len(url) and _alnum(url[end + 1])):
                hits[kind].add(term)
        return {kind: sorted(terms) for kind, terms in hits.items()}

    def __call__(self, url: str | None) -> tuple:
        parts = _URL.search(url or "")
        host, path = (_lower(parts[1]), parts[2]) if parts else ("", "")
        rule, verdict = self.rule(host, path)
        hits = self.found(_lower(url or ""))
        if verdict is None:
            verdict = "block" if hits["strict"] or len(hits["soft"]) >= self.limit else "allow"
        return host, path, rule, verdict, hits["strict"], hits["soft"]


def judge_urls(pages: DataFrame, rules: UrlRules | None = None, url: str = "url", keep: Sequence[str] | None = None) -> DataFrame:
    """Host, path, deciding rule, verdict and the terms found, beside the struct ``row`` of the input's columns (``keep``: of those).

    A null URL, or one without ``://``, has an empty host and path; no rule fits it, and the terms in it decide. Repeated rows are judged
    one by one, an empty table gives an empty result, columns of any name may come along.
    """
    rules = rules or UrlRules()
    columns = [F.col(f"`{c}`") for c in (pages.columns if keep is None else keep)]
    source = pages.select(F.struct(*columns).alias("row"), F.col(f"`{url}`").alias("url"))

    def make():
        judge = Judge(rules)
        return lambda urls: [judge(None if u is None else u.decode()) for u in urls]

    return map_rows(source, make, COLUMNS, carry=["row"])
