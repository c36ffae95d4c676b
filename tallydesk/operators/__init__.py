"""The operators: insights, lookups, search, authority, actions and the audit of tool calls."""
