"""Named rules over deck tables. `catalogue.RULES` lists them; `engine.check` runs them."""
