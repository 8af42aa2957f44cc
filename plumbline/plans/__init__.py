"""Plans that span operators: fixtures, engine, reports, studies."""
