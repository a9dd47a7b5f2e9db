"""Sinks: deliverables as single files, append-only logs, and a run's directory.

Large tables stay distributed (``append_rows``, ``spark`` writers).  The CSV and
JSON deliverables are single files by contract; their rows are streamed through
one partition iterator, so the driver holds one partition at a time.
"""

from __future__ import annotations

import csv
import json
import os
import re
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# columns of the deliverables (fixed values)
CATALOG_HEADER = ["数据源名称", "分类路径", "数据源类型", "粒度", "访问地址", "简要说明", "来源搜索"]
STATS_HEADER = ["分类节点", "候选数", "体裁分布"]
JOURNAL_HEADER = ["阶段", "节点", "查询词", "返回链接数", "提取候选数", "证据缺失", "零提取理由"]
LINEAGE_HEADER = ["阶段", "分类节点", "查询词", "返回结果数", "结果URL", "是否收录", "收录条目名称", "收录理由", "备注"]
STATS_PLACEHOLDER = "（统计缺失）"


def append_rows(df: DataFrame, path: str) -> int:
    """Append rows as JSON lines and return how many; an empty batch creates nothing."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    # an empty batch has nothing to write, and asking costs its first row only
    if df.isEmpty():
        return 0
    rows.write.mode("append").json(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str, header: list[str], skip_empty: bool = False) -> int:
    """A CSV with byte-order mark; fields quoted where they hold commas, quotes or line breaks.

    Written beside its place and renamed, so that a failure leaves no half file.
    """
    rows = df.select(*df.columns[: len(header)]).toLocalIterator()
    first = next(rows, None)
    if first is None and skip_empty:
        return 0
    n = 0
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        while first is not None:
            out.writerow(["" if v is None else v for v in first])
            n += 1
            first = next(rows, None)
    os.replace(part, path)
    return n


def write_attestation(values: dict, path: str) -> bool:
    """The attestation as JSON; a failure to write it does not stop a delivery."""
    try:
        Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
        return True
    except OSError:
        return False


def run_directory(root: str, domain: str, stamp: str) -> Path:
    """The name of a new ``{domain}_{stamp}`` directory, with ``_1``, ``_2`` on collision."""
    clean = re.sub(r'[\s/\\:*?"<>|]', "_", (domain or "").strip()) or "未命名领域"
    base = Path(root) / f"{clean}_{stamp}"
    path, k = base, 0
    while path.exists():
        k += 1
        path = base.with_name(f"{base.name}_{k}")
    return path


@contextmanager
def delivery(path: Path) -> Iterator[Path]:
    """A directory to write into that becomes ``path`` in one step when all is written, and vanishes on a failure."""
    part = path.with_name(f".{path.name}.part")
    shutil.rmtree(part, ignore_errors=True)
    (part / "intermediate").mkdir(parents=True)
    try:
        yield part
        os.rename(part, path)
    finally:
        shutil.rmtree(part, ignore_errors=True)


def archive(run_dir: Path, files: dict[str, str] | list[str]) -> None:
    """Move working files into ``intermediate``, under new names if given; missing ones are skipped."""
    inner = Path(run_dir) / "intermediate"
    inner.mkdir(parents=True, exist_ok=True)
    for f, name in (files if isinstance(files, dict) else {f: Path(f).name for f in files}).items():
        if Path(f).exists():
            shutil.move(f, inner / name)


def append_event(path: Path, code: str, actor: str, now: str, detail: dict) -> None:
    """One line to a run's reject events; a failure to write it does not hide what it tells of."""
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"ts": now, "code": code, "actor": actor, "detail": {k: str(v) for k, v in detail.items()}}, ensure_ascii=False) + "\n")
    except OSError:
        pass


def rename_report(folder: Path, stats: list[tuple[str, int, str]] | None) -> Path | None:
    """The report of a delivery under the delivery's name, with its statistics; None if there is no report."""
    found = sorted(Path(folder).glob("*.md"))
    if not found:
        return None
    to = Path(folder) / f"{Path(folder).name}_报告.md"
    to.with_suffix(".part").write_text(inject_stats(found[0].read_text(encoding="utf-8"), stats), encoding="utf-8")
    os.replace(to.with_suffix(".part"), to)
    if found[0] != to:
        found[0].unlink()
    return to


def inject_stats(report: str, stats: list[tuple[str, int, str]] | None) -> str:
    """The report with its statistics section, replaced where one exists, else after the title."""
    body = STATS_PLACEHOLDER if stats is None else "\n".join(f"- {node}：{n} {types}".rstrip() for node, n, types in stats)
    section = f"## 统计\n\n{body}\n"
    if re.search(r"^## 统计$", report, re.M):
        return re.sub(r"^## 统计\n.*?(?=^## |\Z)", lambda _: section + "\n", report, count=1, flags=re.M | re.S)
    title, _, rest = report.partition("\n")
    return f"{title}\n\n{section}\n{rest.lstrip()}" if title.startswith("# ") else f"{section}\n{report}"
