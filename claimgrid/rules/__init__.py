"""Rules as data: phrase lists, the item ruleset and engine limits."""
