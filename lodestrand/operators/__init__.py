"""Operators over entities, graphs, changes, behaviour, covers, rules and ledgers."""
