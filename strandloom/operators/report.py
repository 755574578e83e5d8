"""Reports of counters as self-contained HTML, Markdown, notebooks for R, or JSON."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of counters that a report collects at most; features and genes beyond the charts are counted on the cluster.
MOST_ROWS = 200_000
TOP, TOP_GENES = 25, 20
# title, counter, order (n: by count, c: by chromosome, i: as a number)
SECTIONS = (
    ("Variants by chromosome", "chrom", "c"), ("Variant classes", "var_class", "n"), ("Base changes", "base_change", "n"), ("InDel length", "indel_len", "i"),
    ("Number of alleles", "n_allele", "i"), ("Known and novel", "known", "n"), ("FILTER", "filter", "n"), ("QUAL", "qual", "q"),
    ("Consequences, all", "cons_all", "n"), ("Consequences, most severe", "cons_severe", "n"), ("Genomic regions", "region", "n"),
    ("Impact, all", "impact", "n"), ("Impact, most severe", "impact_severe", "n"), ("Functional class", "func_class", "n"), ("Biotypes", "biotype", "n"),
    ("Feature types", "feature_type", "n"), ("SIFT", "sift", "n"), ("PolyPhen", "polyphen", "n"), ("Warnings", "errors", "n"),
)


@dataclass
class AnnotStat:
    """Counters with what is known about their source."""

    counts: dict[str, dict[str, int]]
    n_gene: int = 0
    n_feature: int = 0
    genes: list[tuple[str, int]] = field(default_factory=list)
    source: str = ""
    header: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    bytes: int = 0
    created: str = field(default_factory=lambda: datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))

    @property
    def n_variant(self) -> int:
        return self.counts.get("n_var", {}).get("n", 0)

    @property
    def span(self) -> int:
        """Positions between the first and the last variant of each chromosome."""
        return sum(b - a + 1 for a, b in self.ranges.values())

    def merge(self, other: AnnotStat) -> AnnotStat:
        """The statistics of both: counters added, ranges joined, header entries of both (the first one's where they differ),
        sources named in order.  Genes and features are counted by name on the cluster: merge those counters there."""
        counts = {s: dict(c) for s, c in self.counts.items()}
        for s, c in other.counts.items():
            mine = counts.setdefault(s, {})
            for k, n in c.items():
                mine[k] = mine.get(k, 0) + n
        ranges = dict(self.ranges)
        for c, (a, b) in other.ranges.items():
            ranges[c] = (min(a, ranges.get(c, (a, b))[0]), max(b, ranges.get(c, (a, b))[1]))
        source = ", ".join(x for x in (self.source, other.source) if x)
        return AnnotStat(counts, 0, 0, [], source, other.header | self.header, ranges, self.bytes + other.bytes)

    def __repr__(self) -> str:
        return f"AnnotStat({self.source or 'table'}: {self.n_variant:,} variants, {len(self.counts)} counters, created {self.created})"


def collect(counters: DataFrame, source: str = "", header: dict[str, str] | None = None, ranges: DataFrame | None = None, size: int = 0) -> AnnotStat:
    """Bring counters to the driver: all but genes and features, of which only the numbers and the top come.  The counters are
    computed once and written to shared storage.  ranges: those of ``stats.position_ranges``; size: bytes of the source."""
    from pyspark.sql import functions as F

    from strandloom.session import cut

    counters = cut(counters)
    big = F.col("stat").isin("gene_impact", "feature")
    counts: dict[str, dict[str, int]] = {}
    rows = counters.where(~big).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many categories for a report")
    for r in rows:
        counts.setdefault(r.stat, {})[r.category] = r.n
    genes = counters.where("stat = 'gene_impact'").groupBy(F.split_part("category", F.lit("\r"), F.lit(1)).alias("g")).agg(F.sum("n").alias("n"))
    top = [(r.g, r.n) for r in genes.orderBy(F.desc("n"), "g").limit(TOP_GENES).collect()]
    at = {r.chr: (r.pos_min, r.pos_max) for r in ranges.where("pos_min is not null").limit(MOST_ROWS).collect()} if ranges is not None else {}
    return AnnotStat(counts, genes.count(), counters.where("stat = 'feature'").count(), top, source, header or {}, at, size)


def _order(items: dict[str, int], how: str) -> list[tuple[str, int]]:
    def chrom(x):
        s = x[0].removeprefix("chr")
        return (0, int(s), "") if s.isdigit() else (1, 0, s)

    key = {"n": lambda x: (-x[1], x[0]), "c": chrom, "i": lambda x: int(x[0]), "q": lambda x: float(x[0][1:].split(",")[0].replace("-Inf", "-inf"))}[how]
    return sorted(items.items(), key=key)


def sections(stat: AnnotStat) -> list[dict]:
    """Format-independent content: key-value pairs, then one table a counter, then ratios and genes."""
    c = stat.counts
    pairs = [("Generated", stat.created), ("Source", stat.source), *stat.header.items(), ("Variants", f"{stat.n_variant:,}")]
    if stat.ranges and stat.n_variant:
        pairs += [("Span", f"{stat.span:,}"), ("Bases per variant", f"{stat.span / stat.n_variant:,.2f}")]
    if stat.bytes:
        pairs.append(("Bytes", f"{stat.bytes:,}"))
    if "n_annot" in c:
        pairs.append(("Annotation records", f"{c['n_annot'].get('n', 0):,}"))
    if stat.n_gene:
        pairs += [("Genes", f"{stat.n_gene:,}"), ("Features", f"{stat.n_feature:,}")]
    out: list[dict] = [{"title": "General information", "pairs": pairs}]
    for title, name, how in SECTIONS:
        if not c.get(name):
            continue
        section = {"title": title, "rows": _order(c[name], how)}
        if name == "base_change":
            ts = sum(c[name].get(k, 0) for k in ("A>G", "G>A", "C>T", "T>C"))
            tv = sum(n for k, n in c[name].items() if k[0] != k[-1] and set(k) <= set("ACGT>")) - ts
            section["matrix"] = [[n for n in "ACGT"], *[[r, *[c[name].get(f"{r}>{a}", 0) for a in "ACGT"]] for r in "ACGT"]]
            section["note"] = f"transitions {ts:,}, transversions {tv:,}" + (f", ratio {ts / tv:.3f}" if tv else "")
        if name == "func_class" and c[name].get("MISSENSE") and c[name].get("SILENT"):
            section["note"] = f"missense / silent {c[name]['MISSENSE'] / c[name]['SILENT']:.3f}"
        out.append(section)
    if stat.genes:
        out.append({"title": "Genes with most records", "rows": stat.genes, "more": stat.n_gene - len(stat.genes)})
    return out


def _shown(s: dict, top: int = TOP):
    rows, total = s["rows"], sum(n for _, n in s["rows"]) or 1
    return [(k, n, 100 * n / total) for k, n in rows[:top]], s.get("more", 0) + max(0, len(rows) - top)


#: Sections drawn as columns too, in their order.
CHARTS = ("InDel length", "QUAL", "Variants by chromosome")


def _columns(rows: list[tuple[str, int, float]]) -> str:
    """A chart of one column a category."""
    most, w = max(n for _, n, _ in rows) or 1, 18
    bars = "".join(f'<rect x="{i * w}" y="{100 - 100 * n / most:.1f}" width="{w - 3}" height="{100 * n / most:.1f}"><title>{html.escape(k)}: {n:,}</title></rect>' for i, (k, n, _) in enumerate(rows))
    return f'<svg width="{w * len(rows)}" height="100">{bars}</svg>'


def to_html(stat: AnnotStat, title: str) -> str:
    e = html.escape
    body = [f"<h1>{e(title)}</h1>"]
    for s in sections(stat):
        body.append(f"<h2>{e(s['title'])}</h2>")
        if "pairs" in s:
            body.append("<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in s["pairs"]) + "</table>")
            continue
        rows, more = _shown(s)
        most = max(n for _, n, _ in rows) or 1
        bar = lambda n: f'<svg width="200" height="10"><rect width="{200 * n / most:.1f}" height="10"/></svg>'
        body.append("<table>" + "".join(f"<tr><th>{e(k or '(empty)')}</th><td>{n:,}</td><td>{p:.2f}%</td><td>{bar(n)}</td></tr>" for k, n, p in rows) + "</table>")
        if "matrix" in s:
            head, *lines = s["matrix"]
            body.append("<table><tr><th></th>" + "".join(f"<th>{a}</th>" for a in head) + "</tr>" + "".join(f"<tr><th>{r[0]}</th>" + "".join(f"<td>{n:,}</td>" for n in r[1:]) + "</tr>" for r in lines) + "</table>")
        if s["title"] in CHARTS:
            body.append(_columns(rows))
        body += [f"<p>{more:,} more</p>"] * bool(more) + [f"<p>{e(s.get('note', ''))}</p>"] * ("note" in s)
    style = "body{font-family:sans-serif;max-width:60em;margin:auto}th{text-align:left;font-weight:normal}td{text-align:right}rect{fill:#4a78b5}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{e(title)}</title><style>{style}</style></head><body>{"".join(body)}</body></html>'


def to_markdown(stat: AnnotStat, title: str) -> str:
    e = lambda x: str(x).replace("|", "\\|") or "(empty)"
    out = [f"# {title}", ""]
    for s in sections(stat):
        out += [f"## {s['title']}", ""]
        if "pairs" in s:
            out += ["| | |", "|-|-|", *(f"| {e(k)} | {e(v)} |" for k, v in s["pairs"]), ""]
            continue
        rows, more = _shown(s)
        most = max(n for _, n, _ in rows) or 1
        out += ["| category | n | % | |", "|-|-:|-:|-|", *(f"| {e(k)} | {n:,} | {p:.2f} | {'█' * round(20 * n / most)} |" for k, n, p in rows), ""]
        if "matrix" in s:
            head, *lines = s["matrix"]
            out += ["| | " + " | ".join(head) + " |", "|-|" + "-:|" * 4, *("| " + " | ".join([r[0], *(f"{n:,}" for n in r[1:])]) + " |" for r in lines), ""]
        out += [f"{more:,} more", ""] * bool(more) + [s.get("note", ""), ""] * ("note" in s)
    return "\n".join(out)


def to_rmarkdown(stat: AnnotStat, title: str) -> str:
    """A notebook for R: its tables are data frames and its charts bar plots."""
    q = lambda x: json.dumps(str(x), ensure_ascii=False)
    out = ["---", f"title: {q(title)}", "output: html_document", "---", ""]
    for i, s in enumerate(sections(stat)):
        rows = s["pairs"] if "pairs" in s else _shown(s)[0]
        names = ", ".join(q(r[0]) for r in rows)
        out += [f"## {s['title']}", "", "```{r section" + str(i) + ", echo=FALSE}"]
        if "pairs" in s:
            out += [f"knitr::kable(data.frame(item = c({names}), value = c({', '.join(q(r[1]) for r in rows)})))", "```", ""]
            continue
        out += [f"d <- data.frame(category = c({names}), n = c({', '.join(str(r[1]) for r in rows)}))", "d$percent <- round(100 * d$n / " + str(sum(n for _, n in s["rows"]) or 1) + ", 2)", "knitr::kable(d)"]
        out += ["barplot(d$n, names.arg = d$category, las = 2)", "```", "", s.get("note", ""), ""]
    return "\n".join(out)


def write_report(stat: AnnotStat, path: str = "annot_summary.html", format: str = "auto", title: str = "Annotation summary") -> str:
    """Write a report; the format follows the ending of the path (.md and .markdown, .Rmd, .json, else HTML) unless named."""
    if format == "auto":
        format = {".md": "markdown", ".markdown": "markdown", ".rmd": "rmarkdown", ".json": "json"}.get(Path(path).suffix.lower(), "html")
    makers = {"html": to_html, "markdown": to_markdown, "rmarkdown": to_rmarkdown, "json": lambda s, t: json.dumps({"title": t, "sections": sections(s)}, indent=1)}
    Path(path).write_text(makers[format](stat, title))
    return str(Path(path).resolve())


def report(df: DataFrame, path: str = "annot_summary.html", source: str = "", header: dict[str, str] | None = None, **options) -> str:
    """A report of an imported table (variants with the records of an annotator, or none) in one call."""
    from strandloom.operators import stats

    return write_report(collect(stats.annotated_counters(df), source, header, stats.position_ranges(df)), path, **options)
