"""Operators grouped by area: validate (B), policy (C),
vectors (D), audit (E), analytics (F, G, L), registry (H), routing (I),
feeds (J), telemetry (K)."""
