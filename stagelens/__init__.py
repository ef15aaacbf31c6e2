"""Analytics over execution logs and other event data, as DataFrame operators."""
