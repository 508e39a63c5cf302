"""Registered queries over the bundled tables, each with its SQL counterpart where SQL can express it."""
