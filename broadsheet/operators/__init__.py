"""Lazy DataFrame operators. None of them collects, caps or samples rows unless
that is what it computes."""
