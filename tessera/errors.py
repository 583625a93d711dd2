"""Failures of collection operations, named as their status codes."""


class TesseraError(Exception):
    status = "internal"


def _kind(name: str, status: str) -> type[TesseraError]:
    return type(name, (TesseraError,), {"status": status, "__module__": __name__})


DimMismatch = _kind("DimMismatch", "dim_mismatch")
InvalidId = _kind("InvalidId", "invalid_id")
InvalidFrame = _kind("InvalidFrame", "invalid_frame")
TopKTooLarge = _kind("TopKTooLarge", "top_k_too_large")
OutOfCapacity = _kind("OutOfCapacity", "out_of_capacity")
TextTooLong = _kind("TextTooLong", "text_too_long")
EmbedFailed = _kind("EmbedFailed", "embed_failed")
SlotOccupied = _kind("SlotOccupied", "slot_occupied")
ReplayDivergent = _kind("ReplayDivergent", "replay_divergent")
Busy = _kind("Busy", "busy")
