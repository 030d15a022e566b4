"""Text to plan: lexer, parser, syntax tree and planner."""
