"""Plans made of several operators: a layer, a deploy, a collection."""
