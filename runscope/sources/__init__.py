"""Readers of run files and the parsers behind them."""
