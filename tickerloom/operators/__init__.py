"""Relational operators over daily bars, positions, feeds and conversations.

Series bound
------------
Windows partitioned by ``symbol`` are used only on tables holding one row per ``(symbol, date)``. Such a partition
can never exceed the number of calendar days covered (a century is 36,525 rows), no matter how many raw rows one
symbol contributes: surplus copies are folded by :func:`tickerloom.operators.bars.dedup_key`, an aggregation with
map-side combine, before any window sees them.
"""
