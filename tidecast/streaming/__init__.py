"""Streaming: intentionally empty.

The original programs are batch only (no stream source, watermark, trigger or state), so no
streaming operator is built. The batch operators are DataFrame → DataFrame and keyed by
series, so a Structured Streaming job could reuse the counting step inside ``foreachBatch``.
"""
