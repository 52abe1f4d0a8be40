"""Plan shapes shared by the operators: ordered work over hot groups, size-checked broadcasts."""
