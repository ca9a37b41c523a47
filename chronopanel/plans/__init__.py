"""Physical building blocks: bounded units of work over a panel, fold plans."""
