"""Layouts as rows of configuration.

Registry order is priority: it decides ties of the score.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from inkgrid import fixed


def fold_title(title: str) -> str:
    """Driver-side twin of ``normalize_text`` for the few configured titles."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c))
    return plain.strip().lower()


@dataclass(frozen=True)
class Layout:
    layout_id: int
    name: str
    doc_type: str
    titles: tuple[str, ...]
    fingerprint: str
    # how a page qualifies: a table header, words on one line, or a text mark
    needs: str = "header"

    @property
    def folded(self) -> tuple[str, ...]:
        return tuple(fold_title(t) for t in self.titles)


CONTINUATION = Layout(1, "ts_continuation", fixed.TIMECARD, fixed.TITLES_CONTINUATION, fixed.PRINT_CONTINUATION)
TABULAR = Layout(2, "ts_tabular", fixed.TIMECARD, fixed.TITLES_TABULAR, fixed.PRINT_TABULAR)
INTERVAL = Layout(3, "ts_interval", fixed.TIMECARD, fixed.TITLES_INTERVAL, fixed.PRINT_INTERVAL)
MONTHLY = Layout(4, "ps_monthly", fixed.PAYSLIP, fixed.TITLES_MONTHLY, fixed.PRINT_MONTHLY)
RECEIPT = Layout(5, "ps_receipt", fixed.PAYSLIP, fixed.TITLES_RECEIPT, fixed.PRINT_RECEIPT)
BLOCKS = Layout(6, "ps_blocks", fixed.PAYSLIP, fixed.TITLES_BLOCKS, fixed.PRINT_BLOCKS, "words")
LEDGER = Layout(7, "ps_ledger", fixed.PAYSLIP, (), fixed.MARK_MONTH, "mark")

LAYOUTS = (CONTINUATION, TABULAR, INTERVAL, MONTHLY, RECEIPT, BLOCKS, LEDGER)
BY_ID = {layout.layout_id: layout for layout in LAYOUTS}

# Punch columns: (ordinal of the title, kinds of the clocks found there, in order).
PUNCH_COLUMNS = {
    CONTINUATION.layout_id: ((3, ("IN",)), (4, ("OUT",))),
    TABULAR.layout_id: tuple((k, ("IN",) if k % 2 else ("OUT",)) for k in range(1, 9)),
    INTERVAL.layout_id: (
        (1, ("IN",)), (2, ("OUT",)), (3, ("OUT", "IN")), (4, ("OUT", "IN")), (5, ("OUT", "IN")),
    ),
}
