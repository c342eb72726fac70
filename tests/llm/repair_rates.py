"""How much of garbled text the repair finds and restores, by page and layers.

python tests/llm/repair_rates.py /root/testdata/sf0.1: takes all texts of the folder's documents that hold characters beyond ASCII and
aren't found as they are, garbles each as a whole and prints a line for each page and number of layers.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from multiprocessing import Pool
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

from mergestone.llm.garbling import repair  # noqa: E402

PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "mac_roman", "gbk", "cp932")
LEGACY = (("cp1251", "ru"), ("koi8_r", "ru"), ("cp1253", "el"), ("gbk", "zh"), ("euc_jp", "ja"), ("mac_roman", "fr"), ("cp1250", "pl"))


def show(raw: bytes, page: str) -> str:
    """Bytes as a lenient reader shows them: what the page lacks as C1 controls, or as U+FFFD in double-byte pages."""
    if page in ("gbk", "cp932"):
        return raw.decode(page, "replace")
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def rates(texts: list[tuple[str, str]]) -> dict:
    """(kind, page, layers) -> [texts, found, restored] for (text, language) pairs."""
    out: dict = defaultdict(lambda: [0, 0, 0])

    def add(key: tuple, text: str, bad: str) -> None:
        if bad == text:
            return
        r, n = repair(bad), out[key]
        n[0] += 1
        n[1] += r.found
        n[2] += r.text == text

    for text, lang in texts:
        for page in PAGES:
            bad = text
            for layers in range(1, 4 if page == "cp1252" else 2):
                bad = show(bad.encode(), page)
                add(("UTF-8 as", page, layers), text, bad)
        for page, of in LEGACY:
            if lang == of:
                try:
                    raw = text.encode(page)
                except UnicodeEncodeError:
                    continue
                add((f"{of} as cp1252", page, 1), text, show(raw, "cp1252"))
    return dict(out)


def main() -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sys.argv[1]}/documents.parquet", columns=["text", "lang"]).to_pydict()
    rows = [(t, (lang or "").lower()) for t, lang in zip(table["text"], table["lang"]) if t and not t.isascii()]
    with Pool() as pool:
        clean = [row for row, r in zip(rows, pool.map(repair, [t for t, _ in rows], chunksize=100)) if not r.found]
        total: dict = defaultdict(lambda: [0, 0, 0])
        for part in pool.imap_unordered(rates, [clean[i : i + 50] for i in range(0, len(clean), 50)]):
            for key, n in part.items():
                total[key] = [a + b for a, b in zip(total[key], n)]
    print("| kind | page | layers | texts | found | restored |\n| --- | --- | --- | --- | --- | --- |")
    for (kind, page, layers), (n, found, restored) in sorted(total.items()):
        print(f"| {kind} | {page} | {layers} | {n} | {found / n:.4f} | {restored / n:.4f} |")


if __name__ == "__main__":
    main()
