"""Column expressions and the fixed lookup values behind them."""
