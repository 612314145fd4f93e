"""Figures as SVG and HTML text, from small aggregated tables."""
