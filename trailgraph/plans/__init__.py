"""The path language: steps, rewrites and their compilation to joins."""
