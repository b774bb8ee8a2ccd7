"""Column expressions: text helpers, code patterns and word tests."""
