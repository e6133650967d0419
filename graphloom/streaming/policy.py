"""What a micro-batch of file events asks for: nothing, the changed paths, or a full scan."""

from __future__ import annotations

from dataclasses import dataclass

#: Targeted scans in a row before a full one checks them. Fixed value.
FULL_AFTER = 256


@dataclass(frozen=True)
class Policy:
    """State between batches: whether there has been a full scan, and how many targeted ones since."""

    cold: bool = True
    since_full: int = 0

    def decide(self, changed: int, failed: bool = False, dropped: bool = False, uncertain: bool = False) -> tuple[str, "Policy"]:
        """full, targeted or noop, and the state after it. changed: paths in the batch; the flags say that events may be
        missing: the watcher failed, its queue overflowed, or event numbers have a gap."""
        if self.cold or failed or dropped or uncertain or self.since_full >= FULL_AFTER:
            return "full", Policy(False, 0)
        return ("targeted", Policy(False, self.since_full + 1)) if changed else ("noop", self)
